"""Similarity join of sparse count vectors: all pairs with a cosine of a threshold or more.

Equal vectors are one class and joined once. A class meets others through the codes of its prefix: in the order of rising frequency,
those from which on it still holds the threshold's share of its squares. The classes of a code stand in blocks, by share; a cell, two
blocks, is left out where the product of the shares can't reach the threshold, and a code that all have is as many cells as it fills.
In a cell the vectors are multiplied as matrices; a pair counts where the cell's code is the first that it shares, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph_algorithms import written
from riskloom.operators.ordered import with_running_totals

#: Least and most classes of a block (a cell holds the vectors of two); between them a code's classes are cut into ``BLOCKS``, so that a
#: row is copied as often at any size. Bins of shares.
BLOCK, MOST_BLOCK, BLOCKS, BINS = 256, 16_384, 12, 4
#: Products of vectors that a cell holds at a time.
SLICE = 1 << 21
_BIN = 1 << 32


def _cells(prefix: DataFrame, least: float, block: int) -> DataFrame:
    """``prefix(place, rep, share, ...)`` with x and y, its code's blocks that meet, and ``sides``: 1 where the row stands in x, 2 in y,
    3 in a cell of one block. Two rows of a code meet in one cell, unless their bins' shares rule them out."""
    width = (1 - least) / BINS
    rows = prefix.withColumn("bin", F.greatest(F.least(F.floor((F.col("share") - least) / max(width, 1e-12)), F.lit(BINS - 1)), F.lit(0)).cast("long"))
    sizes = rows.groupBy("place", "bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    sizes = sizes.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("bin", "blocks"))).alias("bins"))
    rows = rows.join(sizes, "place")
    most = lambda b: least + (b + 1) * width + 1e-9
    open_bins = F.filter("bins", lambda b: most(b["bin"]) * most(F.col("bin")) >= least)
    others = F.flatten(F.transform(open_bins, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["blocks"] - 1), lambda k: b["bin"] * _BIN + k)))
    blocks = F.filter("bins", lambda b: b["bin"] == F.col("bin"))[0]["blocks"]
    own = F.col("bin") * _BIN + F.pmod(F.xxhash64("rep"), blocks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    sides = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    parties = ["parties"] if "parties" in prefix.columns else []
    return rows.select("place", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "vec", "norm", *parties, sides.alias("sides"))


def _multiplied(threshold: float, counting: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of a cell, or by vector how many parties it meets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        names, place = table.column("rep").combine_chunks(), table.column("place")[0].as_py()
        sides, norm, parties = (table.column(c).to_numpy() for c in ("sides", "norm", "parties"))
        lists = table.column("vec").combine_chunks()
        codes = lists.flatten()
        used, column = np.unique(codes.field("k").to_numpy(), return_inverse=True)
        counts = np.zeros((len(lists), len(used)))
        counts[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), column] = codes.field("n").to_numpy()
        left, right, one_block = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2), (sides == 3).all()
        earlier = (counts[:, used < place] > 0).astype(np.float32)
        rank, met = np.empty(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        rank[np.argsort(np.array(names.to_pylist(), dtype=object))] = np.arange(len(names))
        step = max(1, SLICE // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            good = (counts[own] @ counts[right].T) / (norm[own, None] * norm[None, right]) >= threshold
            good &= earlier[own] @ earlier[right].T == 0
            if counting:
                if one_block:
                    good &= own[:, None] != right[None]
                else:
                    met[right] += (good * parties[own, None]).sum(axis=0)
                met[own] += good @ parties[right]
                continue
            if one_block:
                good &= own[:, None] < right[None]
            a, b = np.nonzero(good)
            a, b = own[a], right[b]
            cosine = (counts[a] * counts[b]).sum(axis=1) / (norm[a] * norm[b])
            low, high = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(cosine, pa.float64())], names=["a", "b", "similarity"])
        if counting:
            some = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(met[some])], names=["rep", "met"])

    return run


def _classes(counts: DataFrame, threshold: float, block: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, classes, cells) of ``counts``."""
    counts = counts.where("p is not null and code is not null and n > 0")
    spread = counts.groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.lit(1).cast("long").alias("one_"))
    places = with_running_totals(spread, [F.col("df"), F.col("code")], {"place": "one_"}).select("code", "place")
    vectors = counts.join(places, "code").groupBy("p").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("k"), F.col("n").cast("double").alias("n")))).alias("vec"))
    vectors = written(vectors, "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, e: s + e["n"] * e["n"])
    classes = written(vectors.groupBy("vec").agg(F.min("p").alias("rep"), F.count(F.lit(1)).alias("parties")).withColumn("square", square), "classes")
    least = threshold * threshold - 1e-9
    state = F.struct(F.lit(0.0).alias("before"), F.array().cast("array<struct<place:bigint,share:double>>").alias("codes"))

    def step(s, e):
        share = 1 - s["before"] / F.col("square")
        codes = F.when(share >= least, F.array_append(s["codes"], F.struct(e["k"].alias("place"), share.alias("share")))).otherwise(s["codes"])
        return F.struct((s["before"] + e["n"] * e["n"]).alias("before"), codes.alias("codes"))

    block = block or min(max(BLOCK, -(-classes.count() // BLOCKS)), MOST_BLOCK)
    prefix = classes.select("rep", "vec", "parties", F.sqrt("square").alias("norm"), F.explode(F.aggregate("vec", state, step, lambda s: s["codes"])).alias("c"))
    return vectors, classes, _cells(prefix.select("rep", "vec", "norm", "parties", "c.*"), least, block).groupBy("place", "x", "y")


def similar_counts(counts: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(p, n): in how many pairs of :func:`similar_pairs` each party stands. Cells count them, so no pair becomes a row: the products grow
    with the square of the classes, the rows don't."""
    vectors, classes, cells = _classes(counts, threshold, block)
    met = cells.applyInArrow(_multiplied(threshold, True), "rep string, met long").groupBy("rep").agg(F.sum("met").alias("met"))
    one = F.col("square") / (F.sqrt("square") * F.sqrt("square"))
    within = F.when(one >= threshold, F.col("parties") - 1).otherwise(0)
    linked = classes.join(met, "rep", "left").select("vec", (F.coalesce("met", F.lit(0)) + within).cast("long").alias("n"))
    return vectors.join(linked.where("n > 0"), "vec").select("p", "n")


def similar_pairs(counts: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(src, dst, similarity), src below dst, of ``counts(p, code, n)``: a row for each party and code, n above 0; null parties and codes
    are left out. A party's vector, its distinct codes, is one array; pairs of classes become pairs of all their parties, as is asked."""
    vectors, classes, cells = _classes(counts, threshold, block)
    pairs = cells.applyInArrow(_multiplied(threshold, False), "a string, b string, similarity double")
    several = classes.where("parties > 1").select("vec", "rep", "square")
    if several.isEmpty():
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity")
    members = written(vectors.join(several, "vec").select("rep", "p", "square"), "members")
    of = lambda end: members.select(F.col("rep").alias(end), F.col("p").alias(f"{end}_p"))
    across = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_p", "a").alias("p"), F.coalesce("b_p", "b").alias("q"), "similarity")
    one = F.col("square") / (F.sqrt("square") * F.sqrt("square"))
    within = members.join(members.select("rep", F.col("p").alias("q")), "rep").where("p < q").select("p", "q", one.alias("similarity")).where(F.col("similarity") >= threshold)
    return across.union(within).select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), "similarity")
