"""Periodic run detection: maximal runs of repeated words, by tandem repeats in a suffix tree.

The suffix tree of a text's words is held as arrays: suffixes in order (its leaves) and the depths at which neighbours part (its inner
nodes, as intervals of leaves). Where two subtrees part at depth D, leaves i and i + D on either side are a branching tandem repeat: D
words, twice, that can't be rotated to the right. Only the smaller side's leaves are walked and i + D and i - D looked up on the other,
so a text of n words costs O(n log n) lookups. Each repeat is rotated to the left as far as it goes; rotations of one run and multiples
of its period merge into one maximal run.

Per text, Python holds arrays of its words, some 200 bytes a word; Spark deals the texts over tasks, a few MB at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices

LEAST_WORDS = 12
#: Leaves of smaller sides that are looked up at a time.
LOOKUPS = 1 << 20

Run = tuple[int, int, int]


def suffix_tree(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, depth): the suffixes in order, each one's place in it, and the words that the suffix at place k shares with the
    one before; by doubling of ranked prefixes. The end of the text comes before all words."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    span = 1
    while rank.max(initial=0) < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        span *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    depth = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # Ranks of equal spans are equal only where both spans lie inside the text, as the end has a rank of its own.
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        shared, a, b = shared + step, a + step, b + step
    depth[1:] = shared
    return order, rank, depth


def _partings(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k from 1 on, the first leaf of the subtree that parts from another one at k, and the end of that other one:
    [first, k) and [k, end) are two subtrees below the node of depth[k]; children of one node part one after the other."""
    n = len(depth)
    first, end = [0] * n, [n] * n
    stack, held = [0], [-1]
    for k, d in enumerate(depth.tolist()[1:], 1):
        while held[-1] > d:
            held.pop()
            end[stack.pop()] = k
        first[k] = stack[-1]
        stack.append(k)
        held.append(d)
    return np.array(first, dtype=np.int64), np.array(end, dtype=np.int64)


def branching_tandem_repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each D words that occur twice on end with another word, or the end, where a third copy would go on."""
    n = len(ids)
    order, rank, depth = suffix_tree(ids)
    first, end = _partings(depth)
    places = np.arange(n)
    deep = (depth > 0) & (depth <= n // 2) & (places > 0)
    k, d, lo, hi = places[deep], depth[deep], first[deep], end[deep]
    left_smaller = k - lo <= hi - k
    at, size = np.where(left_smaller, lo, k), np.where(left_smaller, k - lo, hi - k)
    other_lo, other_hi = np.where(left_smaller, k, lo), np.where(left_smaller, hi, k)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sums = np.concatenate([[0], np.cumsum(size)])
    begin = 0
    while begin < len(k):
        stop = max(begin + 1, int(np.searchsorted(sums, sums[begin] + LOOKUPS, "right")) - 1)
        own = size[begin:stop]
        which = np.repeat(np.arange(begin, stop), own)
        leaf = order[np.arange(len(which)) - np.repeat(sums[begin:stop] - sums[begin], own) + at[which]]
        for way in (1, -1):
            there = leaf + way * d[which]
            ok = (there >= 0) & (there < n)
            place = rank[np.where(ok, there, 0)]
            ok &= (place >= other_lo[which]) & (place < other_hi[which])
            found.append((np.minimum(leaf, there)[ok], d[which][ok]))
        begin = stop
    return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


def _rotations(ids: np.ndarray, start: int, period: int) -> int:
    """Words by which the repeat at ``start`` can be rotated to the left."""
    done, chunk = 0, 8
    while done < start:
        chunk = min(chunk, start - done)
        at = start - done
        differ = np.flatnonzero(ids[at - chunk : at] != ids[at - chunk + period : at + period])
        if len(differ):
            return done + chunk - 1 - int(differ[-1])
        done, chunk = done + chunk, chunk * 2
    return done


def maximal_runs(ids: np.ndarray, least: int = LEAST_WORDS) -> list[Run]:
    """(start, length, period) by start, then period: maximal stretches with smallest period q, of max(least, 2q) words or more.

    A text without two equal stretches of least // 2 words holds none: of a run of L words and period q the first L - q recur q
    words later, and L - q is at least both q and least - q. Such texts, known by hashes of their stretches, need no tree.
    """
    n, short = len(ids), max(1, least // 2)
    if n < least:
        return []
    powers = np.random.default_rng(7).integers(1, 1 << 63, short, dtype=np.uint64) | np.uint64(1)
    hashes = sum(ids[k : n - short + 1 + k].astype(np.uint64) * powers[k] for k in range(short))
    hashes = np.sort(hashes ^ (hashes >> np.uint64(29)))
    if not (hashes[1:] == hashes[:-1]).any():
        return []
    starts, sizes = branching_tandem_repeats(ids)
    by_period = np.lexsort((starts, sizes))
    runs: list[Run] = []
    ending: dict[int, list[tuple[int, int]]] = {}
    for start, period in zip(starts[by_period].tolist(), sizes[by_period].tolist(), strict=True):
        known = ending.setdefault(start + 2 * period, [])
        if any(s <= start and period % p == 0 for s, p in known):
            continue  # the run of a smaller period, some times over
        first = start - _rotations(ids, start, period)
        known.append((first, period))
        if start + 2 * period - first >= least:
            runs.append((first, start + 2 * period - first, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    drop = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words as the query takes them: of a tenth of the ids, a part of the text is made periodic."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def scan(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = LEAST_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, runs (array of start, length, period, by start, then period), collapsed (the words that stay, joined
    by one space). Words are ``[^\\x20\\x09-\\x0D]+``; ``rewrite`` may change them beforehand, given the id.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows are each scanned, null ids pass through,
    other columns are ignored; an empty table gives no rows. Texts are never cut.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found, collapsed = [], []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                words = rewrite(doc_id, words) if rewrite else words
                numbers: dict[bytes, int] = {}
                runs = maximal_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64), least)
                if runs:
                    words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays]
                found.append([{"start": s, "length": k, "period": p} for s, k, p in runs])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (null without one; ties: smallest start, then
    period), runs_sha256 (a line of start, length, period for each run) and collapsed_sha256."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
