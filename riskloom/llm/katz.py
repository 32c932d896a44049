"""Language-model scores by Katz backoff over word n-grams of any order.

    P(w | h) = d(c(hw)) c(hw) / c(h)   if hw was seen in training, else   a(h) P(w | h')   (P(w | h') if h was not seen)
    P(w)     = d(c(w)) c(w) / N        if w was seen, else what the seen words leave, for one unknown word

h' is h without its first word. d: Good-Turing discounts of counts up to ``GT_COUNTS``, from the counts of counts of each order
over all training text. Higher counts lose a fixed ``HIGH_LOSS``, so that every context keeps something for unseen words. a(h)
makes each context sum to one exactly: what its seen words leave, over what the lower order gives to all words not seen after it.

Tables, all in the shared folder: chunks of encoded text; word counts; n-gram counts by order, one row of arrays for each bucket;
context weights, a row for each context, by order. Nothing of the corpus is held by the driver but sums, counts of counts and the
words with more than half a bucket's tokens, twice the buckets at most. A chunk asks each bucket for the total counts of its own
distinct n-grams, and gets them in the order asked; so what is shuffled is distinct n-grams of a million tokens at a time, not
tokens. Buckets hold whole words, with all their n-grams; a hot word's are dealt by context to as many buckets as its count
fills, those of all orders that end in one bigram together. A token takes the highest order it was seen in and the weights of
the contexts above it, which are joined at the end.

Words are known by 64-bit hashes, contexts by 48 bits of them; with 10^9 words some thousand contexts would merge.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_words, removed, slices, written

#: Order of the registered query. Each further order asks for about as many n-grams again.
ORDER = 2
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
LEAST_BUCKETS = 8
GT_COUNTS = 5
HIGH_LOSS = 1e-3
#: The end of a text, predicted like a word, and its start, a context only. No word is empty or blank.
END, START = b"", b" "
HELD_OUT = 10
LOW48 = np.uint64((1 << 48) - 1)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _pack_counts(x: np.ndarray) -> bytes:
    """In the fewest bytes a count that hold the greatest; the first byte tells how many."""
    size = next(n for n in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + _pack(x.astype(f"<u{size}"))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], f"<u{data[0]}").astype(np.int64)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# -- discounts


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(1) .. d(GT_COUNTS) from n(1) .. n(GT_COUNTS + 1) by Good-Turing with Katz's correction. Where those are not all
    strictly between 0 and 1 (few or uneven counts), an absolute discount n1 / (n1 + 2 n2) of each count instead."""
    n = [0, *counts_of_counts]
    k = GT_COUNTS
    if all(n[1 : k + 2]):
        rest = (k + 1) * n[k + 1] / n[1]
        if rest < 1:
            d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)])
            if (d > 0).all() and (d < 1).all():
                return d
    loss = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    return np.array([(r - loss) / r for r in range(1, k + 1)])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for counts of 1 or more."""
    c = np.asarray(c, dtype=np.float64)
    low = np.minimum(c, GT_COUNTS).astype(np.int64) - 1
    return np.where(c <= GT_COUNTS, d[np.maximum(low, 0)] * c, c - HIGH_LOSS)


class Unigrams:
    """P(w) by count: the seen words' discounted shares, and ``unknown`` for the rest, sharing 1 exactly."""

    def __init__(self, tokens: int, words: int, counts_of_counts: list[int], mass: float, d: np.ndarray):
        self.tokens, self.words, self.d = tokens, words, d
        self.unknown = max(1 - mass / tokens, 1 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unknown) / (mass or 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(np.maximum(c, 1), self.d) * self.scale, self.unknown)


def _counts_of_counts(df: DataFrame, column: str) -> list[int]:
    row = df.agg(*[F.count_if(F.col(column) == r).alias(f"n{r}") for r in range(1, GT_COUNTS + 2)]).first()
    return [int(x or 0) for x in row]


# -- chunks of encoded text

CHUNK = "chunk long, held binary, lens binary, stream binary, vocab binary"


def encode(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of whole documents: ids, held-out flags, token counts, token numbers, and the hash of each number's word."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        base, serial = TaskContext.get().partitionId() << 20, 0
        fresh = lambda: ([], bytearray(), array("i"), array("i"), defaultdict(count().__next__))
        ids, held, lens, stream, vocab = fresh()

        def row():
            hashes = np.fromiter(map(word_hash, vocab), dtype=np.uint64, count=len(vocab))
            cells = [[ids], [base + serial], [_pack(np.frombuffer(held, dtype=np.uint8))], [_pack(np.frombuffer(lens, dtype=np.int32))], [_pack(np.frombuffer(stream, dtype=np.int32))], [_pack(hashes)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["ids", "chunk", "held", "lens", "stream", "vocab"])

        types = None
        for batch in slices(batches):
            types = types or [pa.list_(batch.schema.field(0).type), pa.int64(), *[pa.binary()] * 4]
            for doc, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = ascii_words(text)
                words.append(END)
                ids.append(doc)
                held.append(out)
                lens.append(len(words))
                stream.extend(map(vocab.__getitem__, words))
                if len(stream) >= chunk_tokens:
                    yield row()
                    serial += 1
                    ids, held, lens, stream, vocab = fresh()
        if ids:
            yield row()

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT == 0, F.lit(False)).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).alias("text")).mapInArrow(run, f"ids array<{kind.simpleString()}>, {CHUNK}")


class Grams:
    """Distinct n-grams of one order in a chunk, by bucket, then word, then context. w: word's number; context: 48-bit hash;
    short: the context without its first word; suffix: place of the n-gram without its first word among those of the order
    below; place: of each token's n-gram."""

    def __init__(self, w, context, short, suffix, bucket, place):
        self.w, self.context, self.short, self.suffix, self.bucket, self.place = w, context, short, suffix, bucket, place


class Chunk:
    """Arrays of a decoded chunk row: lens and held by document; w by token (numbers); hashes by number, the start's last."""

    def __init__(self, held: bytes, lens: bytes, stream: bytes, vocab: bytes):
        self.held, self.lens, self.w = _unpack(held, "u1"), _unpack(lens, "<i4"), _unpack(stream, "<i4").astype(np.int64)
        self.hashes = np.append(_unpack(vocab, "<u8"), np.uint64(word_hash(START)))
        self.start = len(self.hashes) - 1

    @cached_property
    def firsts(self) -> np.ndarray:
        return np.cumsum(self.lens, dtype=np.int64) - self.lens

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """The value of ``x`` one token earlier; ``at_start`` at the first token of a document."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.firsts] = at_start
        return out

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(self.held, self.lens) == 0

    def grams(self, order: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> list[Grams]:
        """Of the orders 2 to ``order``."""
        hot_words, parts_of = hot
        parts = np.ones(len(self.hashes), dtype=np.uint64)
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, self.hashes), len(hot_words) - 1)
            parts = np.where(hot_words[at] == self.hashes, parts_of[at], 1).astype(np.uint64)
        own = _mixed(self.hashes, np.zeros_like(self.hashes))
        out: list[Grams] = []
        h = self.before(self.w, self.start)
        context_ids, context_hashes = h, self.hashes
        token_short = None
        for _ in range(2, order + 1):
            keys, first, back = np.unique(self.w << 31 | context_ids, return_index=True, return_inverse=True)
            w = keys >> 31
            hashes = context_hashes[keys & ((1 << 31) - 1)]
            bucket = ((own[w] + _mixed(self.hashes[w], self.hashes[h[first]]) % parts[w]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            place = place[back]
            suffix = out[-1].place[first][by] if out else None
            short = token_short[first][by] if out else None
            out.append(Grams(w[by], hashes[by] & LOW48, short, suffix, bucket[by], place))
            token_short = out[-1].context[place]
            context_ids = self.before(place, len(by))
            context_hashes = np.append(_mixed(self.hashes[w[by]], hashes[by]), self.hashes[self.start])
        return out


def _edges(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal elements, and the length."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, dtype=np.int64)


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


# -- counts


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): counts in training texts."""

    def run(batches):
        for batch in batches:
            for cells in _columns(batch, "held", "lens", "stream", "vocab"):
                c = Chunk(*cells)
                n = np.bincount(c.w[np.repeat(c.held, c.lens) == 0], minlength=c.start)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(c.hashes[at].view(np.int64)), pa.array(n[at].astype(np.int64))], names=["word", "n"])

    found = chunks.select("held", "lens", "stream", "vocab").mapInArrow(run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


REQUEST = "bucket int, chunk long, gram_order int, words binary, sizes binary, contexts binary, shorts binary, suffixes binary, counts binary"


def _batch(schema: str, rows: list[dict]) -> dict[str, pa.Array]:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return {k: pa.array([r.get(k) for r in rows], types[t]) for k, t in (x.split() for x in schema.split(", "))}


def requests(chunks: DataFrame, order: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """A row for each chunk, bucket and order: the chunk's distinct n-grams and their training counts. suffixes: places in the
    row of the order below."""
    dealt = _hot_arrays(hot)

    def run(batches):
        for batch in batches:
            for number, *cells in _columns(batch, "chunk", "held", "lens", "stream", "vocab"):
                c = Chunk(*cells)
                trained, below = c.trained, None
                for k, g in enumerate(c.grams(order, buckets, dealt), 2):
                    n = np.bincount(g.place[trained], minlength=len(g.w))
                    edges = _edges(g.bucket)
                    starts = dict(zip(g.bucket[edges[:-1]].tolist(), edges[:-1].tolist(), strict=True))
                    for (number_of, a), b in zip(starts.items(), edges[1:].tolist(), strict=True):
                        runs = _edges(g.w[a:b])
                        row = {"bucket": number_of, "chunk": number, "gram_order": k, "words": c.hashes[g.w[a:b][runs[:-1]]].tobytes(), "sizes": _pack_counts(np.diff(runs)), "contexts": _pack48(g.context[a:b]), "counts": _pack_counts(n[a:b])}
                        if below is not None:
                            row |= {"shorts": _pack(g.short[a:b]), "suffixes": _pack((g.suffix[a:b] - below[number_of]).astype(np.uint32))}
                        yield pa.RecordBatch.from_pydict(_batch(REQUEST, [row]))
                    below = starts

    return chunks.select("chunk", "held", "lens", "stream", "vocab").mapInArrow(run, REQUEST)


def _hot_arrays(hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    words = sorted(hot)
    return np.array(words, dtype=np.uint64), np.array([hot[w] for w in words], dtype=np.int64)


ANSWER = "kind string, bucket int, chunk long, gram_order int, words binary, sizes binary, contexts binary, shorts binary, counts binary, suffix_counts binary, word_counts binary, " + ", ".join(f"n{r} long" for r in range(1, GT_COUNTS + 2))


def answers(asked: DataFrame, hot_counts: dict[int, int]) -> DataFrame:
    """For each chunk, bucket and order an ``answer`` (counts of the n-grams asked for, in order; of bigrams the word_counts of
    their words), and for each bucket and order a ``table`` row of all training n-grams, with their counts of counts."""
    hot_words, hot_n = _hot_arrays(hot_counts)

    def totals(words: np.ndarray, sizes: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and their counts; hot ones' from the corpus, as their n-grams lie in many buckets."""
        own, back = np.unique(words, return_inverse=True)
        each = np.repeat(back, np.concatenate(sizes))
        n = np.zeros(len(own), dtype=np.int64)
        np.add.at(n, each, counts)
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, own), len(hot_words) - 1)
            n = np.where(hot_words[at] == own, hot_n[at], n)
        return own, n

    def run(asked: pa.Table) -> pa.Table:
        names = ("gram_order", "chunk", "bucket", "words", "sizes", "contexts", "shorts", "suffixes", "counts")
        every = sorted(zip(*(asked.column(k).to_pylist() for k in names), strict=True), key=lambda r: r[:2])
        out, below = [], {}  # below: by chunk, the total counts of the order below, in the order asked
        for k in sorted({r[0] for r in every}):
            rows = [r for r in every if r[0] == k]
            words, sizes = [np.frombuffer(r[3], dtype="<u8") for r in rows], [_unpack_counts(r[4]) for r in rows]
            contexts, counts = np.concatenate([_unpack48(r[5]) for r in rows]), np.concatenate([_unpack_counts(r[8]) for r in rows])
            each = np.repeat(np.concatenate(words), np.concatenate(sizes))
            _, first, back = np.unique(_mixed(each, contexts), return_index=True, return_inverse=True)
            total = np.zeros(len(first), dtype=np.int64)
            np.add.at(total, back, counts)
            suffix_counts = shorts = None
            if k == 2:
                own, n_own = totals(np.concatenate(words), sizes, counts)
            else:
                suffix_counts = np.concatenate([below[r[1]][_unpack(r[7], "<u4")] for r in rows])
                shorts = np.concatenate([_unpack(r[6], "<u8") for r in rows])
            below, at = {}, 0
            for (_, chunk, bucket, *_), mine, size in zip(rows, words, sizes, strict=True):
                end = at + int(size.sum())
                below[chunk] = total[back[at:end]]
                out.append({"kind": "answer", "bucket": bucket, "chunk": chunk, "gram_order": k, "counts": _pack_counts(below[chunk])})
                if k == 2:
                    out[-1]["word_counts"] = _pack_counts(n_own[np.searchsorted(own, mine)])
                at = end
            seen = np.flatnonzero(total)
            order = np.lexsort((contexts[first[seen]], each[first[seen]]))
            at, c = first[seen][order], total[seen][order]
            runs = _edges(each[at])
            row = {"kind": "table", "bucket": rows[0][2], "chunk": -1, "gram_order": k, "words": each[at][runs[:-1]].tobytes(), "sizes": _pack_counts(np.diff(runs)), "contexts": _pack48(contexts[at]), "counts": _pack_counts(c)}
            if k == 2:
                row["word_counts"] = _pack_counts(n_own[np.searchsorted(own, each[at][runs[:-1]])])
            else:
                row |= {"shorts": _pack(shorts[at]), "suffix_counts": _pack_counts(suffix_counts[at])}
            out.append(row | {f"n{r}": int((c == r).sum()) for r in range(1, GT_COUNTS + 2)})
        return pa.table(_batch(ANSWER, out))

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def context_key(order: int, context: np.ndarray) -> np.ndarray:
    return (context | np.uint64(order << 48)).astype(np.int64)


def context_weights(grams: DataFrame, unigrams: Unigrams, d: dict[int, np.ndarray]) -> DataFrame:
    """(gram_order, context, n, weight): count and a(h) of every training context, its key telling its order. For order 2 the
    lower order gives P(w); above, it gives d(c(h'w)) c(h'w) / c(h'), whose c(h') is the n of the context h'."""

    def run(batches):
        parts = defaultdict(list)
        for batch in batches:
            for k, sizes, contexts, shorts, counts, suffix_counts, word_counts in _columns(batch, "gram_order", "sizes", "contexts", "shorts", "counts", "suffix_counts", "word_counts"):
                h, c = context_key(k, _unpack48(contexts)), _unpack_counts(counts).astype(np.float64)
                if len(h):
                    p = np.repeat(unigrams.p(_unpack_counts(word_counts)), _unpack_counts(sizes)) if k == 2 else discounted(_unpack_counts(suffix_counts), d[k - 1])
                    own, at, back = np.unique(h, return_index=True, return_inverse=True)
                    short = np.zeros(len(own), dtype=np.int64) if k == 2 else context_key(k - 1, _unpack(shorts, "<u8")[at])
                    parts[k].append((own, short, *(np.bincount(back, weights=x) for x in (c, c - discounted(c, d[k]), p))))
        for k, own in parts.items():
            contexts, at, back = np.unique(np.concatenate([x[0] for x in own]), return_index=True, return_inverse=True)
            short = np.concatenate([x[1] for x in own])[at]
            sums = [np.bincount(back, weights=np.concatenate([x[j] for x in own])) for j in (2, 3, 4)]
            for a in range(0, len(contexts), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(contexts[cut]), k, dtype=np.int32)), pa.array(contexts[cut]), pa.array(short[cut]), *(pa.array(s[cut]) for s in sums)], names=["gram_order", "context", "short", "n", "left", "p"])

    sums = grams.select("gram_order", "sizes", "contexts", "shorts", "counts", "suffix_counts", "word_counts").mapInArrow(run, "gram_order int, context long, short long, n double, left double, p double")
    sums = sums.groupBy("gram_order", "context").agg(F.min("short").alias("short"), *[F.sum(c).alias(c) for c in ("n", "left", "p")])
    if max(d) == 2:
        return sums.select("gram_order", "context", "n", (F.col("left") / F.col("n") / (1 - F.col("p"))).alias("weight"))
    sums = written(grams.sparkSession, sums, "katz-contexts")
    lower = sums.select(F.col("context").alias("short"), F.col("n").alias("lower_n"))
    given = F.when(F.col("gram_order") == 2, F.col("p")).otherwise(F.col("p") / F.col("lower_n"))
    return sums.join(lower, "short", "left").select("gram_order", "context", "n", (F.col("left") / F.col("n") / (1 - given)).alias("weight"))


# -- scores

SCORED = "row long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, unseen array<struct<context: bigint, n: bigint>>"


def chunk_scores(chunks: DataFrame, answered: DataFrame, order: int, buckets: int, hot: dict[int, int], unigrams: Unigrams, d: dict[int, np.ndarray], train_docs: int) -> DataFrame:
    """One row a document: sums over its tokens but for the a(h) of the orders each token wasn't seen in, which ``unseen`` lists."""
    dealt = _hot_arrays(hot)
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    left = chunks.select("chunk", "ids", "held", "lens", "stream", "vocab")
    right = answered.select("chunk", "bucket", "gram_order", "counts", "word_counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(*(left.column(k)[0].as_py() for k in ("held", "lens", "stream", "vocab")))
        ids, number = left.column("ids")[0].values, left.column("chunk")[0].as_py()
        found = sorted(zip(*(right.column(k).to_pylist() for k in ("gram_order", "bucket", "counts", "word_counts")), strict=True), key=lambda r: r[:2])
        grams = c.grams(order, buckets, dealt)
        if [r[:2] for r in found] != [(k, b) for k, g in enumerate(grams, 2) for b in np.unique(g.bucket).tolist()]:
            raise RuntimeError("a chunk's answers are not those it asked for")
        word = np.zeros(len(c.hashes), dtype=np.int64)
        edges = _edges(grams[0].bucket) if grams else np.zeros(1, dtype=np.int64)
        for a, b, r in zip(edges[:-1].tolist(), edges[1:].tolist(), found, strict=False):
            word[grams[0].w[a:b][_edges(grams[0].w[a:b])[:-1]]] = _unpack_counts(r[3])
        word[c.start] = train_docs
        logs = np.log10(unigrams.p(word[c.w]))
        context_count, backed = c.before(word[c.w], train_docs), []
        for k, g in enumerate(grams, 2):
            n = np.concatenate([_unpack_counts(r[2]) for r in found if r[0] == k])[g.place]
            seen = n > 0
            own = np.log10(discounted(np.maximum(n, 1), d[k])) - np.log10(np.maximum(context_count, 1))
            logs = np.where(seen, own, logs)
            backed = [(at[~seen[at]], key[~seen[at]]) for at, key in backed]
            at = np.flatnonzero(~seen & (context_count > 0))
            backed.append((at, context_key(k, g.context[g.place[at]])))
            context_count = c.before(n, train_docs)
        docs = np.repeat(np.arange(len(c.lens)), c.lens)
        total = lambda x: np.bincount(docs, weights=x, minlength=len(c.lens))
        at, keys = np.concatenate([x for x, _ in backed]), np.concatenate([x for _, x in backed])
        by = np.lexsort((keys, docs[at]))
        owner, keys = docs[at][by], keys[by]
        runs = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(runs, len(keys)))
        offsets = np.searchsorted(owner[runs], np.arange(len(c.lens) + 1))
        unseen = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys[runs]), pa.array(n.astype(np.int64))], names=["context", "n"]))
        rows = (number << 24) + np.arange(len(c.lens))
        return pa.table({"doc_id": ids, "row": pa.array(rows), "held_out": pa.array(c.held == 1), "n_tokens": pa.array(c.lens.astype(np.int64)), "n_known": pa.array(total((word > 0)[c.w]).astype(np.int64)), "base_sum": pa.array(total(np.log10(word + 0.1)[c.w])), "score": pa.array(total(logs)), "unseen": unseen})

    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, f"doc_id {id_type}, {SCORED}")


def score(docs: DataFrame, order: int = ORDER, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    Training texts are those whose crc32 of the id as text, mod 10, is not 0; a null id trains. A null or empty text is its
    end token alone. Repeated rows count and are scored each. Without training texts every word is the one unknown, of
    probability 1. Other columns are ignored; an empty table gives no rows. ``order`` is 2 or more.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    chunks = written(spark, encode(docs, chunk_tokens, id_col, text_col), "katz-chunks")
    words = written(spark, word_counts(chunks), "katz-words")
    sums = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, n_words = int(sums[0] or 0), int(sums[1] or 0)
    of_counts = _counts_of_counts(words, "n")
    heavy = {r.word & (1 << 64) - 1: r.n for r in words.where(F.col("n") * 2 > bucket_tokens).collect()}
    hot = {w: -(-2 * n // bucket_tokens) for w, n in heavy.items()}
    end = words.where(F.col("word") == _signed(word_hash(END))).first()
    d1 = discounts(of_counts)
    low = sum(n * r * d1[r - 1] for r, n in enumerate(of_counts[:GT_COUNTS], 1))
    high_words = n_words - sum(of_counts[:GT_COUNTS])
    mass = low + tokens - sum(n * r for r, n in enumerate(of_counts[:GT_COUNTS], 1)) - HIGH_LOSS * high_words
    unigrams = Unigrams(tokens, n_words, of_counts, mass, d1)
    buckets = max(LEAST_BUCKETS, -(-tokens // bucket_tokens))
    found = written(spark, answers(requests(chunks, order, buckets, hot), heavy), "katz-grams", ["kind"])
    removed(words)
    grams = found.where("kind = 'table'")
    ns = {r.gram_order: [int(r[f"n{j}"] or 0) for j in range(1, GT_COUNTS + 2)] for r in grams.groupBy("gram_order").agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, GT_COUNTS + 2)]).collect()}
    d = {k: discounts(ns.get(k, [0] * (GT_COUNTS + 1))) for k in range(2, order + 1)}
    scored = written(spark, chunk_scores(chunks, found.where("kind = 'answer'"), order, buckets, hot, unigrams, d, end.n if end else 0), "katz-scores")
    removed(chunks)
    weights = written(spark, context_weights(grams, unigrams, d), "katz-weights", ["gram_order"])
    removed(found)
    unseen = scored.select("row", F.explode("unseen").alias("u")).select("row", F.col("u.context").alias("context"), F.col("u.n").alias("n"))
    backed = unseen.join(weights.select("context", "weight"), "context").groupBy("row").agg(F.sum(F.col("n") * F.log10("weight")).alias("backoff"))
    rows = scored.drop("unseen").join(backed, "row", "left")
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(math.log10(tokens + 0.1 * (n_words + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
