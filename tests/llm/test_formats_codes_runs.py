"""Chat windows, vector codes and periodic runs against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import chat_format, periodic, queries, vector_codes

DATA = "/root/testdata/sf0.001"
SAID = "</s>[INST] ok [/INST]"

# -- chat windows

CHAT = "conv_id long, turn long, role string, text string"


def tokens_of(text):
    return len(re.findall(chat_format.TOKEN, text)) + chat_format.MARKER_TOKENS


def brute_windows(turns, budget, history_tokens, history_turns):
    """(turns of the window, how many of them are repeated) of one conversation of one segment, in order."""
    head = turns[:1] if turns and turns[0][0] == "system" else []
    size = lambda part: sum(tokens_of(t) for _, t in part)
    out, now, own = [], None, 0
    for k, turn in enumerate(turns):
        if now is not None and size(now) + size([turn]) <= budget:
            now.append(turn)
            continue
        if now is not None:
            out.append((now, own))
        repeated = head if k else []
        room = min(history_tokens, budget - size(repeated) - size([turn]))
        n = 0
        while n < history_turns and k - n - 1 >= len(head) and size(turns[k - n - 1 : k]) <= room:
            n += 1
        repeated = [*repeated, *turns[k - n : k]]
        now, own = [*repeated, turn], len(repeated)
    return out + ([(now, own)] if now is not None else [])


def made_conversations(rng, n=60):
    out = []
    for c in range(n):
        roles = [*(["system"] if rng.random() < 0.4 else []), *[rng.choice(["user", "assistant", "tool", "system"]) for _ in range(rng.randint(1, 25))]]
        for k, role in enumerate(roles):
            text = rng.choice(["", "a\\b " * 3, SAID, "[ROLE]x[/ROLE] <s>", "word " * rng.randint(1, 60), "漢字 é\n" * rng.randint(1, 10), "long " * 900])
            out.append((c, k, role, text))
    return out


def test_windows_against_brute_force(spark):
    rows = made_conversations(random.Random(3))
    args = (120, 40, 3)
    found = chat_format.turns_of(chat_format.windows(spark.createDataFrame(rows, CHAT), *args), new_only=False).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[2], r[3]))
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.conv_id, r.window)):
        got[r.conv_id].append(([(t.role, t.text) for t in r.turns], r.n_repeated))
        own = r.turns[r.n_repeated :]
        assert r.learned == [t.text for t in own if t.role == "assistant"]
        assert r.n_turns == len(r.turns) and r.over_budget == (r.tokens > args[0])
        assert not r.over_budget or len(own) == 1  # only a turn that is too long by itself goes over
    for c, turns in by.items():
        assert got[c] == brute_windows(turns, *args)


def test_control_strings_are_reversible(spark):
    texts = [SAID, "\\", "\\\\</s>", "<\\/s>", "<<s>>", "[SYS][/SYS]", "[ROLE]", "", "[[INST]]", "\n</s>\\n", "<\\s>"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", chat_format.escaped(F.col("text")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("text"))).alias("back")).collect():
        assert r.back == r.text
        assert not re.search(r"</?s>|\[/?(SYS|INST|ROLE)\]", r.e)


def test_long_conversations_are_cut_into_segments(spark):
    """The system turn goes to each segment; every turn is new once; the digest is of the whole conversation."""
    n = chat_format.SEGMENT_TURNS * 3 + 7
    rows = [(1, k, "system" if not k else ("user", "assistant")[k % 2], f"turn {k} " + SAID) for k in range(n)] + [(2, 0, "user", "x"), (None, 300, "assistant", "late"), (None, None, "user", None)]
    df = spark.createDataFrame(rows, CHAT)
    formatted = chat_format.windows(df)
    found = chat_format.turns_of(formatted, new_only=False).where("conv_id = 1").orderBy("segment", "window").collect()
    assert {r.segment for r in found} == {0, 1, 2, 3}
    assert all(r.turns[0].text == "turn 0 " + SAID and r.turns[0].role == "system" for r in found)
    assert [t.text for r in found for t in r.turns[r.n_repeated :]] == [r[3] for r in rows if r[0] == 1]
    assert all(r.n_repeated > 1 for r in found[1:])  # history crosses segments
    check_digest(rows, chat_format.digest(df, formatted))


def check_digest(rows, found):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    found = {r.conv_id: r for r in found.collect()}
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_edge_cases(spark, monkeypatch):
    rows = [(1, 0, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, None, "assistant", ""), (None, 5, "assistant", "b"), (None, 5, "assistant", "a"), (3, -4, "system", "s"), (3, 10**12, "assistant", "far")]
    df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit("clash") for c in ("segment", "window", "loss", "turns", "tokens", "again", "at", "last")})
    formatted = chat_format.windows(df)
    check_digest(rows, chat_format.digest(df, formatted))
    monkeypatch.setattr(chat_format, "MOST_IDS", 0)  # the way of more conversations than are broadcast
    check_digest(rows, chat_format.digest(df, formatted))
    none = df.limit(0)
    assert chat_format.digest(none, chat_format.windows(none)).isEmpty()


def test_chat_query_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    found = queries.op11_chat(spark, DATA)
    want = con.sql(queries.oracle_sql()["op11_chat"])
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


# -- vector codes


def test_trees_find_the_lowest_of_the_nearest():
    rng = np.random.default_rng(5)
    for n, width, spread in ((256, 4, 3), (256, 16, 1000), (7, 2, 2), (1, 3, 5), (40, 0, 1), (256, 1, 4)):
        points, asked = (rng.integers(-spread, spread + 1, (k, width)) for k in (n, 3000))
        index, distance = vector_codes.Tree.of(points).nearest(asked)
        every = ((asked[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, x int"


def made_vectors(rng, n=700, width=8):
    rows = [(int(k), [float(v) for v in np.round(rng.normal(size=width), 2)], int(rng.integers(0, 3)) if rng.random() < 0.9 else None, "clash", 1, 2) for k in rng.permutation(n)]
    rows += rows[:5] + [(None, [0.5] * width, None, None, 1, 2), (7, [9.0] * width, 1, None, 1, 2)]
    bad = [(n + 1, None, 1), (n + 2, [1.0, None] + [0.0] * (width - 2), 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] + [0.0] * (width - 1), 1)]
    return rows, [(*r, "clash", 1, 2) for r in bad]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([np.float32(r[1]) for r in rows]).astype(np.float64)).astype(np.int64)
    w = x.shape[1] // parts
    books = [x[:entries, p * w : p * w + w].copy() for p in range(parts)]
    near = lambda p: ((x[:, None, p * w : p * w + w] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            own = near(p).argmin(axis=1)
            books[p] = np.array([[int(v) // int((own == e).sum()) for v in x[own == e, p * w : p * w + w].sum(axis=0)] if (own == e).any() else b for e, b in enumerate(books[p])])
    every = [near(p) for p in range(parts)]
    error = sum(d.min(axis=1) for d in every)
    labels = defaultdict(int)
    for r, e in zip(rows, error.tolist(), strict=True):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{d[k].argmin():02x}" for d in every), int(error[k]), labels[r[2]], sha) for k, r in enumerate(rows))


def test_codes_against_brute_force(spark):
    good, bad = made_vectors(np.random.default_rng(2))
    df = spark.createDataFrame(good + bad, VECTORS).repartition(5)
    found = vector_codes.compress(df).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == brute_codes(good)


def test_large_components_are_exact(spark):
    good, _ = made_vectors(np.random.default_rng(9), 300)
    good = [(i, [v * 5e4 for v in x], *r) for i, x, *r in good if i is not None]
    assert max(abs(v) for _, x, *_ in good for v in x) * 1024 < vector_codes.limit(2)
    found = vector_codes.compress(spark.createDataFrame(good, VECTORS)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == brute_codes(good)
    assert vector_codes.limit(16) == 1 << 27 and all((2 * vector_codes.limit(w)) ** 2 * w < 1 << 63 for w in range(1, 5000))


def test_codes_edge_cases(spark):
    make = lambda rows: spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    assert vector_codes.compress(make([(1, None, 1)])).isEmpty() and vector_codes.compress(make([])).isEmpty()
    few = vector_codes.compress(make([(1, [1.0, 2.0, 3.0], 1), (2, [1.0], 1), (3, [], None), (4, [1e30] * 3, 2)])).collect()
    assert {(r.vec_id, r.code, r.error) for r in few} == {(1, "00000000", 0), (2, "00010100", 0), (3, "02010100", 0), (4, "03030300", 0)}


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = vector_codes.kept(df)
    books = vector_codes.fit(rows)
    back = vector_codes.decode(vector_codes.encode(rows, books), books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    gaps = [np.sum((np.array(r.approximation) - np.array(r.embedding)) ** 2) for r in back]
    assert np.mean(gaps) < 0.7 * np.mean([np.sum(np.array(r.embedding) ** 2) for r in back])


def test_codes_query_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_codes"])
    assert sorted(map(tuple, queries.op12_codes(spark, DATA).select(*want.columns).collect())) == sorted(want.fetchall())


# -- periodic runs


def brute_runs(ids, least=12):
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, k, p) for (s, k), p in out.items())


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
        ids = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            ids = ids[:a] + [ids[a + (i - a) % p] for i in range(a, n)]
        least = rng.choice([2, 5, 12])
        assert periodic.maximal_runs(np.array(ids, dtype=np.int64), least) == brute_runs(ids, least)


def test_suffix_tree():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 200):
        ids = rng.integers(0, 2, n)
        order, rank, depth = periodic.suffix_tree(ids)
        text = ids.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:]) and (rank[order] == np.arange(n)).all()
        for k in range(1, n):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert depth[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_long_periodic_texts_take_little_time():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 100_000:
        fibonacci, before = fibonacci + before, fibonacci
    for ids in (np.zeros(200_000), np.arange(200_000) % 3, np.arange(200_000) % 5000, np.array(fibonacci), np.arange(300_000)):
        began = time.time()
        periodic.maximal_runs(ids.astype(np.int64))
        assert time.time() - began < 30


def test_periodic_scan(spark):
    texts = [None, "", " \t\n ", "a b c d " * 5, "a " * 11, "a " * 12, " ".join(f"w{k}" for k in range(40)), "x y " * 10 + "z " + "x y " * 10, "é 漢 q " * 9, "p q r s t u v w " * 3 + "tail"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])] + [(1000 + k, " ".join(f"w{j % 50}" for j in range(60 + k))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "collapsed", "start", "length", "period")})
    got = sorted(map(str, periodic.digest(periodic.scan(df, periodic.planted)).collect()))
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in runs)]
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(names, r, strict=True)) + ")" for r in want)
    assert any(r[1] for r in want if r[0] and r[0] >= 1000)
    assert periodic.scan(df.limit(0)).isEmpty()
