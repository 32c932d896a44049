"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

The set is a sorted array of 64-bit window hashes with, for each, the window's words; a hit of a hash is verified word for word,
so the result is exact. A window is hashed only where all its words occur in the benchmark at all.

The set's size is measured before anything is broadcast. Up to ``BROADCAST_BYTES`` it goes to every task, and one pass over
the documents finds all hits. Beyond, only a filter of fixed size goes (one bit for each of ``FILTER_BITS`` hash values);
windows that pass it are joined to the benchmark's windows by their hash, through a shuffle, and verified there. Either way the
marks of all windows are brought together before anything is counted or cut.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices, written

NGRAM_WORDS = 10
#: Bytes of hashes, words and item ids up to which the set is broadcast.
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 1 << 26
#: Shares of a window in the join by hash, so that a passage in many documents is met by several tasks.
SALTS = 16

#: Bytes of a word: letters and digits of ASCII and all of other characters; A-Z lower-cased, the rest to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _word_codes(words: list[bytes]) -> np.ndarray:
    codes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, from the words' codes."""
    out = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = (out ^ codes[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return (out + np.uint64(n)) * _STEP


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(hash, n, window, items): the distinct windows, their words joined by spaces, and their items' ids, sorted. Items with
    a null id or without words are left out."""

    def run(batches):
        for batch in slices(batches):
            out = defaultdict(list)
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised_words(text)
                if words:
                    k = min(n, len(words))
                    for i, h in enumerate(window_hashes(_word_codes(words), k).view(np.int64).tolist()):
                        out["hash"].append(h)
                        out["n"].append(k)
                        out["window"].append(b" ".join(words[i : i + k]).decode("utf-8", "surrogatepass"))
                        out["item"].append(item)
            types = {"hash": pa.int64(), "n": pa.int32(), "window": pa.string(), "item": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    found = items.mapInArrow(run, "hash long, n int, window string, item string")
    return found.groupBy("hash", "n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


@dataclass
class WindowSet:
    """hashes sorted, with equal ones in a row; windows and items in the same order."""

    hashes: np.ndarray
    windows: list[bytes]
    items: list[list[str]]
    vocabulary: frozenset[bytes]
    lengths: list[int]

    @classmethod
    def of(cls, rows: Iterable) -> WindowSet:
        rows = sorted((r.hash & (1 << 64) - 1, r.window.encode("utf-8", "surrogatepass"), list(r["items"])) for r in rows)
        words = [w.split() for _, w, _ in rows]
        return cls(np.array([h for h, *_ in rows], dtype=np.uint64), [w for _, w, _ in rows], [i for *_, i in rows], frozenset(x for w in words for x in w), sorted({len(w) for w in words}))

    def find(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(start, end, item ids) of every window that occurs in ``words``."""
        found = []
        if not len(self.hashes):
            return found
        for a, codes, starts in _candidates(words, self.vocabulary, self.lengths):
            at = np.searchsorted(self.hashes, codes)
            near = np.minimum(at, len(self.hashes) - 1)
            for k in np.flatnonzero(self.hashes[near] == codes).tolist():
                i, j = int(starts[k]), int(at[k])
                window = b" ".join(words[i : i + a])
                while j < len(self.hashes) and self.hashes[j] == codes[k]:
                    if self.windows[j] == window:
                        found.append((i, i + a, self.items[j]))
                    j += 1
        return found


def _candidates(words: list[bytes], vocabulary: frozenset[bytes] | None, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, window hashes, starts) of the windows whose words are all in the vocabulary (None: all words are)."""
    known = np.ones(len(words), dtype=np.int64) if vocabulary is None else np.fromiter(map(vocabulary.__contains__, words), dtype=np.int64, count=len(words))
    if not known.any():
        return
    sums, codes = np.concatenate(([0], np.cumsum(known))), None
    for n in lengths:
        if len(words) >= n and len(starts := np.flatnonzero(sums[n:] - sums[:-n] == n)):
            if codes is None:
                codes = np.zeros(len(words), dtype=np.uint64)
                codes[known == 1] = _word_codes([w for w, k in zip(words, known.tolist(), strict=True) if k])
            yield n, window_hashes(codes, n)[starts], starts


def _scanned(found: WindowSet, text_at: int, finish):
    """A pass over batches: ``finish(batch, texts, [(marks, items)])`` of each."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            each = [found.find(normalised_words(t)) for t in texts]
            yield finish(batch, texts, [([p for a, b, _ in x for p in (a, b)], sorted({i for *_, own in x for i in own})) for x in each])

    return run


def _filter_of(windows: DataFrame) -> np.ndarray:
    """The filter's bits, from every hash; the driver holds this array of fixed size alone."""
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in windows.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("b")).groupBy((F.col("b") / 65536).cast("long").alias("page")).agg(F.collect_set("b").alias("bs")).toLocalIterator():
        at = np.array(r.bs, dtype=np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _joined(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """(row__, marks, items) of the rows with a hit, by a shuffled join on the window hash; ``docs`` has row__."""
    bits, lengths = _filter_of(windows), sorted(r.n for r in windows.select("n").distinct().collect())

    def run(batches):
        for batch in slices(batches):
            out = defaultdict(list)
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised_words(text)
                for n, codes, starts in _candidates(words, None, lengths):
                    place = (codes % np.uint64(FILTER_BITS)).astype(np.int64)
                    for k in np.flatnonzero(bits[place >> 3] >> (place & 7) & 1).tolist():
                        i = int(starts[k])
                        out["row__"].append(row)
                        out["start"].append(i)
                        out["hash"].append(int(codes[k].view(np.int64)))
                        out["window"].append(b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass"))
            types = {"row__": pa.int64(), "start": pa.int64(), "hash": pa.int64(), "window": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    met = docs.select("row__", F.col(text_col).alias("text")).mapInArrow(run, "row__ long, start long, hash long, window string")
    met = met.withColumn("salt", F.pmod("row__", F.lit(SALTS)).cast("int"))
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = met.join(salted, ["hash", "window", "salt"]).select("row__", "start", "n", "items")
    marks = F.flatten(F.collect_list(F.array(F.col("start"), F.col("start") + F.col("n"))))
    return hits.groupBy("row__").agg(marks.alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _run(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_bytes: int, text_col: str, item_id_col: str, item_text_col: str, finish, schema) -> DataFrame:
    """``finish`` over ``docs`` with all marks, by the broadcast set or, beyond ``broadcast_bytes``, by the join."""
    spark = docs.sparkSession
    windows = written(spark, benchmark_windows(benchmark, n, item_id_col, item_text_col), "benchmark-windows")
    weight = F.octet_length("window") + 100 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 60)
    if (windows.agg(F.sum(weight)).first()[0] or 0) <= broadcast_bytes:
        names = docs.columns
        return docs.mapInArrow(_scanned(WindowSet.of(windows.collect()), names.index(text_col), finish), schema)
    kept = written(spark, docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row__")), "decontamination-rows")
    marks = _joined(kept.select("row__", F.col(f"row.{text_col}").alias(text_col)), windows, text_col)
    rows = kept.join(marks, "row__", "left").select("row", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    columns = [f.name for f in docs.schema]

    def run(batches):
        for batch in slices(batches):
            row = batch.column("row")
            own = pa.RecordBatch.from_arrays([row.field(k) for k in range(len(columns))], names=columns)
            yield finish(own, own.column(columns.index(text_col)).to_pylist(), list(zip(batch.column("marks").to_pylist(), batch.column("items").to_pylist(), strict=True)))

    return rows.mapInArrow(run, schema)


def _hit(words: int, marks: list[int]) -> np.ndarray:
    hit = np.zeros(words, dtype=bool)
    for a, b in zip(marks[::2], marks[1::2], strict=True):
        hit[a:b] = True
    return hit


def report(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM_WORDS, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids), contaminated.

    A null or empty text has no words and no hits. Items with a null id, and items without words, match nothing;
    an item of fewer than ``n`` words is one window. Repeated documents are each reported, repeated items count once.
    An empty benchmark hits nothing; other columns of either table are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def finish(batch, texts, found):
        words = [len(normalised_words(t)) for t in texts]
        hits = [int(_hit(w, marks).sum()) for w, (marks, _) in zip(words, found, strict=True)]
        shas = [hashlib.sha256(",".join(ids).encode()).hexdigest() for _, ids in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for _, i in found], pa.int64()), pa.array(shas, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], names=names)

    kind = df.schema["doc_id"].dataType.simpleString()
    return _run(df, benchmark, n, broadcast_bytes, "text", item_id_col, item_text_col, finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cut(text: str, marks: list[int]) -> str:
    """``text`` without the words in the ranges; what separates the rest stays as it is, once at each cut."""
    data = text.encode("utf-8", "surrogatepass")
    plain, ends, at = data.translate(_TABLE), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    hit = _hit(len(ends), marks)
    out, start = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    for a, b in edges.tolist():
        out.append(data[start : ends[a][0]])
        start = ends[b - 1][1]
    return b"".join([*out, data[start:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = NGRAM_WORDS, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without contaminated documents (``remove="documents"``) or with the hit words of all windows cut
    out of their texts at once (``remove="spans"``). Edge cases as in :func:`report`; rows without a hit come back as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")

    def finish(batch, texts, found):
        if remove == "documents":
            return batch.filter(pa.array([not marks for marks, _ in found], pa.bool_()))
        at = batch.schema.get_field_index(text_col)
        cut = [_cut(t, marks) if marks else t for t, (marks, _) in zip(texts, found, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return _run(docs, benchmark, n, broadcast_bytes, text_col, item_id_col, item_text_col, finish, docs.schema)
