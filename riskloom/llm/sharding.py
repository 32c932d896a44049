"""Sharding by size-tiered compaction: small immutable shards, merges of similar sizes, versioned manifests.

A store is a folder: ``data/`` with immutable Parquet shards, ``manifest/v<N>`` with one committed list of live shards for
each version, ``intent/`` with a file for each writer that has not committed yet. ``append`` writes arrivals as small shards.
``compact`` puts the live shards into size tiers, each ``TIER_FACTOR`` times the last, cuts each tier's shards in order of arrival
into runs of about the target size, and writes each run of two shards or more as one file, until no run is left. Shards of half
the target size or more are done, so rows are rewritten once for each tier that they rise at most. ``vacuum`` deletes files that
no version from the given one on lists and no writer is about to commit.

A version is committed by renaming a finished manifest to a name that must not exist yet; a reader or a crash sees the old list
or the new one. That needs a file system whose rename is atomic and exclusive, such as HDFS or a local disk; object stores
(``OBJECT_STORES``) don't give it and are refused. Rows are handled by DataFrame operations; the driver and the windows over a
manifest handle paths of shards only, 1.6 million of them for 100 TB at the default target size, less at a larger one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import shared_dir

TARGET_BYTES = 64 << 20
TIER_FACTOR = 4
#: After so long a writer that has not committed counts as dead, and its files as garbage.
INTENT_SECONDS = 7 * 24 * 3600
OBJECT_STORES = frozenset("s3 s3a s3n gs oss cos cosn wasb wasbs swift".split())
MANIFEST = "shard string, rows long, bytes long, tier int, born long"


class ShardStore:
    """A store in a folder that all executors reach. One writer commits a version; a second one fails and may retry."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target_bytes = spark, path.rstrip("/"), target_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        if (scheme := self._fs.getUri().getScheme()) in OBJECT_STORES:
            raise ValueError(f"{scheme} renames neither atomically nor exclusively, which commits need")

    # -- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version (the last by default); none before the first."""
        version = version or max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:09d}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Makes ``shards`` version ``base + 1``; raises if another writer has committed that version already."""
        made = f"{self.path}/manifest/.tmp-{uuid.uuid4().hex}"
        shards.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(made)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._path(made), self._path(f"{self.path}/manifest/v{base + 1:09d}"), no_options)
        return base + 1

    # -- shards

    @contextmanager
    def _intent(self, kind: str, base: int) -> Iterator[str]:
        """The name of a new folder under data/, with an intent for it until its shards are committed. A failure leaves the
        intent, which keeps the files for a while; they are garbage once it is old."""
        name = f"{kind}{base + 1:09d}-{uuid.uuid4().hex[:8]}"
        mark = self._path(f"{self.path}/intent/{name}")
        self._fs.create(mark, False).close()
        yield name
        self._fs.delete(mark, False)

    def _listed(self, folder: str, born: int) -> DataFrame:
        """Manifest rows of what was just written to ``folder``: sizes from the files, rows from their footers."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        listed = files.groupBy("shard", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        return listed.select("shard", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"), F.lit(born).cast("long").alias("born"))

    def _tier(self, size):
        """0: half the target size or more, which is not merged again; each further tier is ``TIER_FACTOR`` times smaller."""
        return F.greatest(F.lit(0), F.ceil(F.log(float(TIER_FACTOR), F.lit(self.target_bytes / 2) / size))).cast("int")

    def append(self, arrivals: DataFrame) -> int:
        """Writes arrivals as small shards, at least one for each partition, and commits them. Returns the version."""
        base = max(self.versions(), default=0)
        with self._intent("a", base) as name:
            folder = f"{self.path}/data/{name}"
            arrivals.write.option("compression", "zstd").parquet(folder)
            return self.commit(self.manifest(base).unionByName(self._listed(folder, base + 1)), base)

    def runs(self, manifest: DataFrame) -> DataFrame:
        """(shard, run): shards that one merge puts together. The windows run over the shards of a tier, not their rows."""
        order = Window.partitionBy("tier").orderBy("born", "shard").rowsBetween(Window.unboundedPreceding, -1)
        placed = manifest.where("tier > 0").withColumn("piece", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / self.target_bytes))
        sizes = placed.groupBy("tier", "piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = sizes.withColumn("run", F.row_number().over(Window.orderBy("tier", "piece")) - 1)
        return placed.join(sizes, ["tier", "piece"]).select("shard", "run")

    def compact(self) -> int:
        """Merges until no tier has a run of two shards left; each pass leaves fewer shards. Returns the last version."""
        base = max(self.versions(), default=0)
        while True:
            live = self.manifest(base)
            merged = self.runs(live).collect()  # paths only
            if not merged:
                return base
            count = 1 + max(r.run for r in merged)
            plan = self.spark.createDataFrame([(r.shard, r.run) for r in merged], "plan_shard string, plan_run long")
            schema = self.spark.read.parquet(merged[0].shard).schema
            read = self.spark.read.schema(schema).parquet(*[r.shard for r in merged])
            names = [F.col(c) for c in schema.names]
            rows = read.select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("from_shard"))
            rows = rows.join(F.broadcast(plan) if len(merged) <= 10_000 else plan, F.col("from_shard") == F.col("plan_shard"))
            rows = rows.select("row", F.col("plan_run").alias("run__")).repartitionById(count, F.col("run__").cast("int"))
            rest = live.join(plan, F.col("shard") == F.col("plan_shard"), "left_anti")
            with self._intent("c", base) as name:
                folder = f"{self.path}/data/{name}"
                rows.select("row.*", "run__").write.option("compression", "zstd").partitionBy("run__").parquet(folder)
                base = self.commit(rest.unionByName(self._listed(folder, base + 1)), base)

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version; ``with_shard`` adds the path of the shard as ``shard``."""
        shards = [r.shard for r in self.manifest(version).select("shard").collect()]
        if not shards:
            raise ValueError("the store has no rows")
        rows = self.spark.read.schema(self.spark.read.parquet(shards[0]).schema).parquet(*shards)
        return rows.select("*", F.col("_metadata.file_path").alias("shard")) if with_shard else rows

    def _folder(self, path) -> str:
        """The folder under data/ that a file's path is in."""
        return str(path.toString()).split(f"{self._path(self.path).toUri().getPath()}/data/", 1)[-1].split("/", 1)[0]

    def vacuum(self, oldest: int | None = None) -> int:
        """Deletes shards that no version from ``oldest`` (the last by default) on lists, and older manifests. Files are listed
        first, then writers, then versions: what a writer commits meanwhile is kept by its intent or by its version."""
        files, found = self._fs.listFiles(self._path(f"{self.path}/data"), True), []
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().startswith("part-"):
                found.append(path)
        intents = self._path(f"{self.path}/intent")
        marks = list(self._fs.listStatus(intents)) if self._fs.exists(intents) else []
        writing = {m.getPath().getName() for m in marks if time.time() - m.getModificationTime() / 1000 < INTENT_SECONDS}
        versions = self.versions()
        oldest, live = oldest or max(versions, default=0), set()
        for v in versions:
            if v >= oldest:
                live |= {r.shard.rpartition("/")[2] for r in self.manifest(v).select("shard").collect()}
            else:
                self._fs.delete(self._path(f"{self.path}/manifest/v{v:09d}"), True)
        gone = [p for p in found if p.getName() not in live and self._folder(p) not in writing]
        for path in gone:
            self._fs.delete(path, False)
        return len(gone)


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Appends ``docs`` to a new store in the shared folder, compacts it and returns its rows, read back through the
    committed manifest: all columns of ``docs`` plus shard (the file's path), shard_rows, shard_bytes, shard_tier and
    manifest_version. Nulls, empty texts and repeated rows are stored as they are; an empty table gives no rows. A column of
    ``docs`` with one of the added names raises ValueError."""
    added = ("shard", "shard_rows", "shard_bytes", "shard_tier", "manifest_version")
    if clash := sorted(set(docs.columns) & {*added, "run__"}):
        raise ValueError(f"documents already have columns {clash}")
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs)
    version = store.compact()
    store.vacuum()
    if store.manifest(version).isEmpty():
        empty = docs.limit(0).select(*docs.columns, *[F.lit(None).cast(t).alias(c) for c, t in zip(added, ("string", "long", "long", "int", "long"), strict=True)])
        return spark.createDataFrame([], empty.schema)
    listed = store.manifest(version).select("shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("tier").alias("shard_tier"))
    rows = store.read(version, with_shard=True).join(listed, "shard")
    return rows.select(*docs.columns, *added[:4], F.lit(version).cast("long").alias("manifest_version"))
