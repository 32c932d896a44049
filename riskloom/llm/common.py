"""Shared pieces of the training-data operators: shared folder, written tables, words, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text handed to the per-document Python code at a time, so that long texts don't pile up.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one of our own that
    goes when the driver ends; only a local master may leave it unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Has Spark drop the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors. The shuffle files of
    the writing query go with its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer, before = df.write.option("compression", "zstd"), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that no later query reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8. bytes.lower() and
    bytes.split() touch ASCII only, which is exactly that definition."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterable[pa.RecordBatch]:
    """Cuts batches into runs of at most ``SLICE_ROWS`` rows and ``most_bytes`` bytes of text, or one row of more."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), at + SLICE_ROWS)
            yield batch.slice(at, end - at)
            at = end


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """60 pseudo-random bits from an md5, as a long: the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges(a, b)``; nodes without an edge are absent.

    Hooking and pointer jumping (a label takes its label's label, the neighbours' labels' labels, and passes
    them to its parent), so the rounds grow with the logarithm of the largest component. Every lookup is a
    join that adaptive execution may split, every minimum is combined before its shuffle, and each round is
    written to the shared folder. Null ends are dropped; repeated edges and loops change nothing.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v")).distinct()
    both = written(spark, both, "cc-edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("f")).selectExpr("node", "least(node, f) as f")
    labels = written(spark, labels, "cc-labels")
    for _ in range(most_rounds):
        parents = labels.selectExpr("node as p", "f as ff")
        jumped = labels.join(parents, F.col("f") == F.col("p")).select("node", "f", "ff")
        near = both.join(jumped, F.col("u") == F.col("node")).groupBy("v").agg(F.min("ff").alias("m"))
        hooked = near.join(labels, F.col("v") == F.col("node")).select(F.col("f").alias("node"), "m")
        none = F.lit(None).cast("long")
        after = (
            jumped.select("node", F.col("f").alias("old"), F.least("f", "ff").alias("new"))
            .union(near.select(F.col("v").alias("node"), none.alias("old"), F.col("m").alias("new")))
            .union(hooked.select("node", none.alias("old"), F.col("m").alias("new")))
            .groupBy("node")
            .agg(F.min("new").alias("f"), F.min("old").alias("old"))
        )
        after = written(spark, after, "cc-labels")
        labels = after.select("node", "f")
        if after.where("f <> old").isEmpty():
            return labels.withColumnRenamed("f", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
