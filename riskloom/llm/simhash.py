"""SimHash near-duplicates: segment popcounts as an embedding, a grid range join on them, exact verification.

Two fingerprints at Hamming distance r are at Manhattan distance r or less once each is mapped to the bit counts
of its 2-bit segments, so that distance is a lower bound. The counts are held in unary (0, 1, 2 as 00, 01, 11),
which makes the Manhattan distance one XOR and one bit count. The grid: the 32 segments fall into blocks;
a Manhattan distance of 2 or less leaves all but 2 blocks with equal counts, so near pairs share the grid cell of one
of the block combinations. The number of blocks follows the number of fingerprints, so that one of them meets at most
``CELL_MATES`` others by chance, whatever the corpus (see :func:`blocks_for`); the result does not depend on it. What
still crowds a cell are real groups: a cell of more than ``CELL_ROWS`` fingerprints emits no pairs, as these would grow with
the square of the group; its fingerprints are linked through hubs instead (see :func:`near_links`), which is exact as well.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_words, connected_components, slices, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
LEAST_BLOCKS, MOST_BLOCKS = 4, 16
CELL_MATES = 4.0
CELL_ROWS = 64
#: A fingerprint of over 1 / HOT_SHARE of all rows is hot: its rows are joined in SALTS parts.
HOT_SHARE, SALTS = 256, 64


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for null or no words."""
    words = ascii_words(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def unary_counts(fp: Column) -> Column:
    """The 32 segment bit counts of a fingerprint, each in unary in its own two bits."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def cell_keys(counts: Column, blocks: int) -> list[Column]:
    """One grid cell for each choice of ``blocks - MAX_BITS`` blocks whose counts must agree."""
    ends = [2 * round(32 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    chosen = combinations(range(blocks), blocks - MAX_BITS)
    return [F.xxhash64(F.lit(n), counts.bitwiseAND(F.lit(_signed(sum(masks[b] for b in c))))) for n, c in enumerate(chosen)]


def blocks_for(prints: int) -> int:
    """The fewest blocks with which a fingerprint shares cells with at most ``CELL_MATES`` random others: the counts of a
    segment agree with probability 3/8, those of a cell's segments all at once with its power."""
    chance = lambda b: math.comb(b, MAX_BITS) * (3 / 8) ** (32 * (b - MAX_BITS) / b)
    return next((b for b in range(LEAST_BLOCKS, MOST_BLOCKS) if prints * chance(b) <= CELL_MATES), MOST_BLOCKS)


def near_links(spark: SparkSession, prints: DataFrame, blocks: int = LEAST_BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that chains of ``MAX_BITS`` or fewer differing bits connect.

    ``prints(fp)`` are distinct. Cells of up to ``cell_rows`` rows give their verified pairs. Fingerprints of larger
    cells are keyed by themselves and by each of their 64 single-bit flips: two fingerprints share such a hub exactly
    if 2 or fewer bits differ, so linking each to the smallest of its hub loses nothing and is linear in the cell.
    """
    counted = prints.select("fp", unary_counts(F.col("fp")).alias("counts"))
    cells = counted.select("fp", "counts", F.explode(F.array(*cell_keys(F.col("counts"), blocks))).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(spark, cells.join(sizes, "cell").select("cell", "fp", "n"), "simhash-cells")
    lists = shared.where(F.col("n") <= cell_rows).groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = lists.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b")
    manhattan = F.bit_count(unary_counts(F.col("a")).bitwiseXOR(unary_counts(F.col("b"))))
    close = pairs.where(manhattan <= MAX_BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    crowded = shared.where(F.col("n") > cell_rows).select("fp").distinct()
    flips = [F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)]]
    hubs = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "b")
    starred = hubs.join(least, "hub").select(F.col("fp").alias("a"), "b").where("a <> b")
    return close.select("a", "b").union(starred).distinct()


def near_duplicates(docs: DataFrame, blocks: int | None = None, cell_rows: int = CELL_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, component) for every row of ``docs``.

    component: one fingerprint of the component, the same for all its rows. component_id: the smallest id reachable over links of ``MAX_BITS`` or fewer differing bits, itself included.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id take part; a component of
    null ids only has a null component_id. Repeated rows stay repeated. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = written(spark, with_fingerprints(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")), "simhash-prints")
    first = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    rows, distinct = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    labels = connected_components(spark, near_links(spark, first.select("fp"), blocks or blocks_for(distinct), cell_rows))
    joined = labels.join(first, F.col("node") == F.col("fp")).select("fp", "label", "first_id")
    least = joined.groupBy("label").agg(F.min("first_id").alias("least_id"))
    linked = joined.join(least, "label").select("fp", "label", "least_id")
    ids = first.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("label", "fp").alias("component"))
    hot = [r.fp for r in first.where(F.col("n") * HOT_SHARE > rows).select("fp").collect()]  # fewer than HOT_SHARE
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    own = prints.withColumn("salt", F.when(is_hot, F.col("salt")).otherwise(0))
    return own.join(salted, ["fp", "salt"]).select("doc_id", "fp", "component_id", "component")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row for each near-duplicate component: that of the smallest id. Of several rows with that id the
    one of the component is kept, and of several of these that of the smallest text. A component whose ids are all null
    keeps one row of its smallest text, a null text only if it has no other."""
    spark = docs.sparkSession
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = written(spark, near_duplicates(docs, **options).select("doc_id", "fp", "component_id", "component").distinct(), "simhash-found")
    spread = found.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("component").alias("k"))
    split = written(spark, spread.where("k > 1").select(F.col("doc_id").alias("split_id__")), "simhash-split")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("component_id").alias("kept_id__"), "component", "fp")
    plain = kept.select("kept_id__").distinct().join(split, F.col("kept_id__") == F.col("split_id__"), "left_anti")
    own = docs.join(plain, docs[id_col] == F.col("kept_id__"), "left_semi").dropDuplicates([id_col])
    # ids with texts of several components, and rows without an id: told apart by their texts' fingerprints
    several = docs.join(split, docs[id_col] == F.col("split_id__"), "left_semi")
    texts = with_fingerprints(several.select(text_col, F.struct(id_col, text_col).alias("key")).distinct(), "key", text_col)
    texts = texts.select(F.col(f"doc_id.{id_col}").alias("kept_id__"), F.col(f"doc_id.{text_col}").alias("kept_text__"), "fp").join(kept, ["kept_id__", "fp"])
    least = texts.groupBy("component").agg(F.min_by(F.struct("kept_id__", "kept_text__"), F.struct(F.col("kept_text__").isNull(), F.col("kept_text__"))).alias("k"))
    least = least.select("k.kept_id__", "k.kept_text__")
    chosen = several.join(least, (docs[id_col] == F.col("kept_id__")) & docs[text_col].eqNullSafe(F.col("kept_text__")), "left_semi").dropDuplicates([id_col, text_col])
    nameless = docs.where(docs[id_col].isNull())
    alone = found.where("component_id is null").select("fp", "component").distinct()
    texts = with_fingerprints(nameless.select(text_col).distinct(), text_col, text_col).join(alone, "fp")
    least = texts.groupBy("component").agg(F.min("doc_id").alias("kept_text__"))
    return own.union(chosen).union(nameless.join(least, docs[text_col].eqNullSafe(F.col("kept_text__")), "left_semi").dropDuplicates([text_col]))
