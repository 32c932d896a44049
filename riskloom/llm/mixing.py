"""Mixing sources to target weights: multivariate-hypergeometric splitting tree over exact block quotas.

Targets: sources, in code point order with null last, weigh 5, 2, 1, repeating, and share the words of all documents;
a target stops at ``MOST_REPEATS`` times its source's size and the excess is reshared by weight.

Blocks: every row has a permuted place in its source, a 60-bit hash of its source, id, text and ordinal among rows equal in
these; so repeated rows and rows without an id have places of their own. A block is a range of places with about the same
number of words in every source. A source's quota is exact: all its blocks as often as its target holds it whole, then, in
one more pass, the first blocks of the permuted order up to the one in which the target lies, which is cut there. The cut is
found through the word sums of 4096 hash ranges, then of 4096 parts of the range that holds it, then of its places. One
further row, of the size nearest to what is still lacking, joins the cut block if that brings the source nearer its target.

Tree: at each node over the output shards the quotas of all sources are split in two by a multivariate hypergeometric draw, so
a shard's composition is that of a fair draw without replacement. The driver splits the first levels, tasks the subtrees below.
Each leaf takes its own run of each source's permuted block instances. What is taken of a row is what the leaves took: the
instances of its block that some leaf holds. Rows are shuffled within their shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import unit_hash, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17
SHARD_WORDS = 2_000_000
#: Blocks of a shard, on average; a quota of the tree is below 10^9 blocks, which is 10^14 words.
SHARD_BLOCKS = 16
#: Nodes that the driver splits before tasks go on.
DRIVER_NODES = 64
#: Sources up to which the one row for each source is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
PLACE_BITS = 60


def _numbered(docs: DataFrame) -> DataFrame:
    """(row__, doc_id, source, text): ``row__`` tells the rows of this one evaluation apart."""
    return docs.select(F.monotonically_increasing_id().alias("row__"), "doc_id", F.col("source").cast("string").alias("source"), F.col("text"))


def _source_key(source) -> F.Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def sized_documents(numbered: DataFrame) -> DataFrame:
    """(row__, doc_id, source, source_key, size, id_key, tie, part), without the texts. ``numbered`` as :func:`_numbered` gives."""
    id_key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    tie = F.coalesce(F.md5("text"), F.lit("null"))
    return numbered.select("row__", "doc_id", "source", _source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), id_key.alias("id_key"), tie.alias("tie"), F.shiftrightunsigned("row__", 33).alias("part"))


def placed_documents(sized: DataFrame) -> DataFrame:
    """(row__, doc_id, source, source_key, size, place). Rows equal in source, id and text are numbered from 0 on by their
    scan task's share and their order in it, so that a large group of them meets in no single task; which of them has which
    number makes no difference to the result."""
    same = ["source_key", "id_key", "tie"]
    shares = sized.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*same, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).where("before > 0")
    rows = sized.withColumn("within", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row__")) - 1)
    rows = rows.join(shares, [*same, "part"], "left").withColumn("ordinal", F.col("within") + F.coalesce("before", F.lit(0)))
    return rows.select("row__", "doc_id", "source", "source_key", "size", unit_hash(f"mix{SEED}", *map(F.col, same), F.col("ordinal")).alias("place"))


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Target by source from size by source. In the order of how soon a source is full, those before the first that isn't
    are; the rest share what is left by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    rest, share, out = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: (MOST_REPEATS * sizes[s] / weight[s], s is None, s or "")):
        cap = MOST_REPEATS * sizes[s]
        if cap / weight[s] > rest / share:
            break
        out[s], rest, share = float(cap), rest - cap, share - weight[s]
    rate = rest / share if share else 0.0
    return {s: out.get(s, weight[s] * rate) for s in order}


def _small(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def _level(rows: DataFrame, part: str) -> DataFrame:
    """Of each source: the part in which the cut lies and the words before it. ``rows``: source_key, rest, before, size, part."""
    sums = rows.groupBy("source_key", "rest", "before", part).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source_key").orderBy(part))
    held = sums.withColumn("upto", F.col("before") + running).where("upto > rest")
    first = held.groupBy("source_key").agg(F.min(F.struct(part, (F.col("upto") - F.col("words")).alias("ahead"))).alias("cut"))
    return first.select("source_key", F.col(f"cut.{part}").alias(f"cut_{part}"), F.col("cut.ahead").alias("ahead"))


@dataclass
class Goal:
    """Of a source. passes: whole ones; cut_place: rows below it are in the last pass (None: no row); best_place and best_size:
    of the further row (None: none)."""

    source_key: str
    source_size: int
    target: float
    passes: int = 0
    rest: float = 0.0
    cut_place: int | None = None
    best_place: int | None = None
    best_size: int | None = None


def goals_of(placed: DataFrame) -> list[Goal]:
    """The sources' goals, by key. The driver holds one row for each source."""
    spark = placed.sparkSession
    sizes = {r.source: (r.source_key, int(r.n)) for r in placed.groupBy("source_key", "source").agg(F.sum("size").alias("n")).collect()}
    goals = {}
    for source, target in targets({s: n for s, (_, n) in sizes.items()}).items():
        key, size = sizes[source]
        passes = math.floor(target / size) if size else 0
        goals[key] = Goal(key, size, target, passes, target - passes * size)
    if not goals:
        return []
    rests = spark.createDataFrame([(g.source_key, g.rest) for g in goals.values()], "source_key string, rest double")
    rows = placed.select("source_key", "size", "place").join(_small(rests, len(goals)), "source_key")
    rows = rows.withColumns({"part1": F.shiftright("place", PLACE_BITS - 12), "part2": F.shiftright("place", PLACE_BITS - 24).bitwiseAND(F.lit(4095)), "before": F.lit(0).cast("long")})
    cut1 = _level(rows, "part1").withColumnRenamed("ahead", "ahead1")
    inside = rows.join(_small(cut1, len(goals)), "source_key").where("part1 = cut_part1").withColumn("before", F.col("ahead1"))
    cut2 = _level(inside, "part2").withColumnRenamed("ahead", "ahead2")
    last = inside.join(_small(cut2, len(goals)), "source_key").where("part2 = cut_part2").withColumn("before", F.col("ahead2"))
    lacks = []
    for r in _level(last, "place").collect():
        goals[r.source_key].cut_place = r.cut_place
        lacks.append((r.source_key, r.cut_place, goals[r.source_key].rest - r.ahead))
    cuts = spark.createDataFrame(lacks, "source_key string, cut_place long, lack double")
    gap = F.abs(F.col("size") - F.col("lack"))
    beyond = placed.select("source_key", "size", "place").join(_small(cuts, len(goals)), "source_key").where((F.col("place") >= F.col("cut_place")) & (gap < F.col("lack")))
    for r in beyond.groupBy("source_key").agg(F.min(F.struct(gap.alias("gap"), "place", "size")).alias("best")).collect():
        goals[r.source_key].best_place, goals[r.source_key].best_size = r.best.place, r.best.size
    return sorted(goals.values(), key=lambda g: g.source_key)


# -- the tree


def split(own: np.ndarray, low: int, high: int, shards: int, total: int, seed: int) -> tuple[np.ndarray, int]:
    """The quotas of the left half of the shards ``low`` to ``high``, by a multivariate hypergeometric draw in proportion to
    the halves, and the first shard of the right half."""
    mid = (low + high) // 2
    left = total * mid // shards - total * low // shards
    rng = np.random.default_rng([seed, low, high])
    return rng.multivariate_hypergeometric(own, left, method="marginals"), mid


def subtree(nodes: list[tuple], shards: int, total: int, seed: int, most: int | None = None) -> list[tuple]:
    """``nodes`` (low, high, quotas, starts of the runs) split down to leaves, or until ``most`` nodes are there."""
    done: list[tuple] = []
    while nodes and (most is None or len(nodes) + len(done) < most):
        fresh = []
        for low, high, own, start in nodes:
            if high - low == 1:
                done.append((low, high, own, start))
                continue
            part, mid = split(own, low, high, shards, total, seed)
            fresh += [(low, mid, part, start), (mid, high, own - part, start + part)]
        nodes = fresh
    return done + nodes


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Block counts by shard and source. Row sums differ by one at most, column sums are the quotas."""
    own = np.asarray(quotas, dtype=np.int64)
    leaves = subtree([(0, shards, own, np.zeros_like(own))], shards, int(own.sum()), seed)
    return np.array([x[2] for x in sorted(leaves, key=lambda x: x[0])])


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 to n - 1 at ``x``: four Feistel rounds over the next even number of bits, walked until
    inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, n]).integers(1, 1 << 63, 4, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for key in keys:
            mixed = (b + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((mixed >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    out = once(np.asarray(x, dtype=np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def shard_blocks(spark: SparkSession, quotas: list[int], bits: list[int], shards: int, seed: int) -> DataFrame:
    """(source_nr, block, pass, mix_shard) for each drawn block instance: instance ``pass * 2^bits + block`` of a source
    stands at some place of its permuted order, and the leaf whose run holds that place takes it."""
    own, total = np.asarray(quotas, dtype=np.int64), int(sum(quotas))
    nodes = subtree([(0, shards, own, np.zeros_like(own))], shards, total, seed, DRIVER_NODES) if total else []
    rows = [(low, high, own.tolist(), start.tolist()) for low, high, own, start in nodes]
    top = spark.createDataFrame(rows, "low long, high long, own array<long>, start array<long>")
    names = ["source_nr", "block", "pass", "mix_shard"]

    def run(batches):
        for batch in batches:
            for low, high, own, start in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for shard, _, own_, start_ in subtree([(low, high, np.array(own), np.array(start))], shards, total, seed):
                    for k in np.flatnonzero(own_).tolist():
                        at = permuted(np.arange(start_[k], start_[k] + own_[k]), quotas[k], seed + k)
                        columns = [np.full(len(at), k), at & ((1 << bits[k]) - 1), at >> bits[k], np.full(len(at), shard)]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return top.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def allot(numbered: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, int]:
    """(row__, doc_id, source, size, place, source_size, target, at) for each row, ``at`` listing (pass, mix_shard) for each
    time that a leaf takes it; and the number of shards. The driver holds one row for each source."""
    spark = numbered.sparkSession
    sized = written(spark, sized_documents(numbered), "mix-sizes")
    placed = written(spark, placed_documents(sized), "mix-places")
    goals = goals_of(placed)
    sources = len(goals)
    total = math.floor(sum(g.target for g in goals))
    shards = max(1, -(-total // shard_words))
    block_words = max(1, total // (shards * SHARD_BLOCKS))
    bits = [max(0, (max(1, r.source_size) // block_words).bit_length()) for r in goals]
    last = [0 if r.cut_place is None else (r.cut_place >> (PLACE_BITS - b)) + 1 for r, b in zip(goals, bits, strict=True)]
    quotas = [(r.passes << b) + m for r, b, m in zip(goals, bits, last, strict=True)]
    blocks = written(spark, shard_blocks(spark, quotas, bits, shards, seed), "mix-blocks")
    schema = "source_key string, source_nr long, bits int, passes int, cut_place long, best_place long, best_size long, cut_block long, source_size long, target double"
    rows = [(r.source_key, k, b, r.passes, r.cut_place, r.best_place, r.best_size, m - 1, r.source_size, r.target) for k, (r, b, m) in enumerate(zip(goals, bits, last, strict=True))]
    goal = spark.createDataFrame(rows, schema)
    cut = goal.join(blocks, (goal.source_nr == blocks.source_nr) & (goal.cut_block == blocks.block) & (goal.passes == blocks["pass"]), "left").select(*[goal[c] for c in goal.columns], blocks.mix_shard.alias("cut_shard"))
    lists = blocks.groupBy("source_nr", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("pass"), F.col("mix_shard")))).alias("held"))
    known = placed.join(_small(cut, sources), "source_key").withColumn("block", F.expr(f"shiftrightunsigned(place, {PLACE_BITS} - bits)"))
    known = known.join(lists, ["source_nr", "block"], "left")
    below = F.coalesce(F.col("place") < F.col("cut_place"), F.lit(False))
    kept = F.coalesce(F.filter("held", lambda x: (x["pass"] < F.col("passes")) | below), F.array().cast("array<struct<pass:bigint,mix_shard:bigint>>"))
    extra = (F.col("place") == F.col("best_place")) & (F.col("size") == F.col("best_size"))
    at = F.when(extra, F.array_append(kept, F.struct(F.col("passes").cast("long").alias("pass"), F.col("cut_shard").alias("mix_shard")))).otherwise(kept)
    return known.select("row__", "doc_id", "source", "size", "place", "source_size", "target", at.alias("at")), shards


def plan(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies, source.

    Null and empty texts have size 0; null is a source of its own, the last; a source without words has target 0 and
    nothing of it is taken. Rows without an id and rows that repeat one, in one source or several, are drawn each by itself;
    equal rows share what is drawn of them as evenly as it goes. No row is taken over ``MOST_REPEATS`` times. Other columns are
    ignored; an empty table gives no rows. Reruns agree, as only hashes of source, id, text and ordinal decide.
    """
    rows, _ = allot(_numbered(docs), shard_words, seed)
    copies = F.size("at").cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix: rows of ``docs``, all columns, as often as the leaves took them, plus ``mix_shard``; one partition for each
    shard (up to 16 shards in one where there are over 4096), in shuffled order. Edge cases as in :func:`plan`."""
    spark = docs.sparkSession
    if "mix_shard" in docs.columns:
        raise ValueError("documents already have a column mix_shard")
    kept = written(spark, docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row__")), "mix-rows")
    numbered = kept.select("row__", F.col("row.doc_id"), F.col("row.source").cast("string").alias("source"), F.col("row.text"))
    rows, shards = allot(numbered, shard_words, seed)
    taken = rows.where(F.size("at") > 0).select("row__", "place", F.explode("at").alias("at"))
    taken = taken.select("row__", F.col("at.mix_shard").alias("mix_shard"), unit_hash(f"order{seed}", F.col("place"), F.col("at.pass")).alias("mix_order"))
    parts = min(shards, max(4096, shards // 16))
    own = kept.join(taken, "row__").repartitionById(parts, (F.col("mix_shard") % parts).cast("int"))
    return own.sortWithinPartitions("mix_shard", "mix_order").select("row.*", "mix_shard")
