"""Immutable shards with size-tiered compaction and versioned manifests, in DataFrame operations only.

A store is a folder with `shards/` (Parquet files that are never changed) and `manifests/`, one table per version that
lists the live shards with their rows, bytes and tier. An append writes its rows as they come, one small shard per task,
without a shuffle. Compaction takes one tier at a time, smallest first: its shards, in order of size, are dealt into
groups of about the target size, and each group becomes one file. A version is committed by renaming its manifest into
place, which fails if that version exists already (renaming is atomic on HDFS and local disks; an object store needs a
committer that creates a file only if it is absent). Readers see one version or the other. Old versions and their files
stay until vacuum() removes those that are older than readers need, and files that no manifest ever listed with them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import delete, fresh, hadoop

TARGET_BYTES, TIER_BYTES, FANOUT, KEEP_SECONDS = 64 << 20, 1 << 20, 4, 7 * 24 * 3600.0
_MANIFEST = "path string, rows long, bytes long, tier int"


def _decoded(path: str):
    """A file's path as readers take it: the metadata column has it with escapes. A plus sign is one."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


class ConflictError(RuntimeError):
    """Another writer has committed the version that this one was based on."""


class ShardStore:
    """A versioned set of shards of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = TARGET_BYTES, tier_bytes: int = TIER_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target, self.unit, self.fanout = target_bytes, tier_bytes, fanout

    # versions

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.path}/manifests")
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first append."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/v{v:08d}") if v else self.spark.createDataFrame([], _MANIFEST)

    def _commit(self, based_on: int, manifest: DataFrame) -> int:
        made = f"{self.path}/tmp/{uuid.uuid4().hex}"
        manifest.select("path", "rows", "bytes", "tier").coalesce(1).write.parquet(made)
        fs, source = hadoop(self.spark, made)
        _, folder = hadoop(self.spark, f"{self.path}/manifests")
        fs.mkdirs(folder)
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        _, target = hadoop(self.spark, f"{self.path}/manifests/v{based_on + 1:08d}")
        if self.version() > based_on:
            raise ConflictError(f"version {based_on} is not the newest")
        try:
            context.rename(source, target, options)
        except Exception as e:
            raise ConflictError(f"version {based_on + 1} could not be committed") from e
        return based_on + 1

    # shards

    def _written(self, folder: str) -> DataFrame:
        """Manifest rows of the files in a folder; reads no columns."""
        seen = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder).select(_decoded("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return self._tiered(seen.groupBy("path", "bytes").agg(F.count("*").alias("rows")))

    def _tiered(self, shards: DataFrame) -> DataFrame:
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.col("bytes") / self.unit)) + 1).cast("int")
        return shards.withColumn("tier", F.when(F.col("bytes") * 2 >= self.target, F.lit(99)).otherwise(tier))

    def append(self, rows: DataFrame) -> int:
        """Write rows as new shards and commit them; returns the version. Without rows no shard is listed."""
        v = self.version()
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        rows.select(*[f"`{f.name}`" for f in self.schema.fields]).write.option("compression", "zstd").parquet(folder)
        return self._commit(v, self.manifest(v).unionByName(self._written(folder)))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        # Paths are what the scan's own file index holds on the driver in any case.
        return self._files([r.path for r in self.manifest(version).select("path").collect()])

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # compaction

    def plan(self, least: int | None = None) -> DataFrame:
        """Groups (path, bytes, tier, out) of the smallest tier that has at least `least` shards; empty if none has."""
        small = self.manifest().filter("tier < 99")
        full = small.groupBy("tier").count().filter(F.col("count") >= (least or self.fanout)).agg(F.min("tier").alias("tier"))
        order = Window.partitionBy("tier").orderBy("bytes", "path")
        before = F.sum("bytes").over(order) - F.col("bytes")
        return small.join(F.broadcast(full), "tier").withColumn("out", F.floor(before / self.target).cast("int"))  # one row

    def _slots(self, n: int) -> DataFrame:
        """For each of n partitions a key that Spark's hash partitioning puts there, so that no two groups share a task."""
        ids = self.spark.range(20 * n + 20).select(F.col("id").cast("int").alias("key"))
        return ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("slot")).agg(F.min("key").alias("key"))

    def compact(self, least: int | None = None, older_than: float = KEEP_SECONDS) -> int:
        """Merge tier by tier until no tier has `least` shards (fanout if not given, 2 at least); returns the version.

        A merge is committed only if it wrote as many rows as it read. Versions that are not older than `older_than` seconds
        stay readable; see vacuum()."""
        while True:
            v = self.version()
            groups = self.plan(max(2, least or self.fanout)).select("path", "out")
            chosen = groups.collect()  # one row per small shard, as the scan of these files needs them
            if not chosen:
                return v
            folder = f"{self.path}/shards/{uuid.uuid4().hex}"
            n = len({r.out for r in chosen})
            rows = self._files([r.path for r in chosen])
            at, out, key = fresh(rows, "at", "out", "key")
            rows = rows.withColumn(at, _decoded("_metadata.file_path"))
            dealt_to = groups.join(self._slots(n), F.col("out") == F.col("slot")).select(F.col("path").alias(at), F.col("out").alias(out), F.col("key").alias(key))
            dealt = rows.join(dealt_to, at).drop(at).repartition(n, key).drop(key)
            dealt.write.option("compression", "zstd").partitionBy(out).parquet(folder)
            rest = self.manifest(v).join(groups.select("path"), "path", "left_anti")
            written = self._written(folder)
            had, has = (x.agg(F.sum("rows")).first()[0] or 0 for x in (self.manifest(v).join(groups.select("path"), "path", "left_semi"), written))
            if had != has:
                raise RuntimeError(f"{had} rows were to be merged and {has} were written; version {v} stays")
            self._commit(v, rest.unionByName(written))
            self.vacuum(older_than=older_than)

    def vacuum(self, keep: int = 1, older_than: float = KEEP_SECONDS) -> None:
        """Remove manifests but the newest `keep`, then shards that no manifest lists, such as those of failed appends. What
        was written in the last `older_than` seconds stays, as readers and writers may still use it."""
        fs, folder = hadoop(self.spark, f"{self.path}/manifests")
        limit = (time.time() - older_than) * 1000
        written = {int(x.getPath().getName()[1:]): x.getModificationTime() for x in fs.listStatus(folder)} if fs.exists(folder) else {}
        for v in sorted(written)[: -keep or None]:
            if written[v] <= limit:
                delete(self.spark, f"{self.path}/manifests/v{v:08d}")
        live = {p.rsplit("/shards/", 1)[1].split("/")[0] for v in self.versions() for p in (r.path for r in self.manifest(v).select("path").collect())}
        _, shards = hadoop(self.spark, f"{self.path}/shards")
        for x in fs.listStatus(shards) if fs.exists(shards) else []:
            # An append or a merge has a folder of its own, which goes as a whole.
            if x.getPath().getName() not in live and x.getModificationTime() <= limit:
                delete(self.spark, x.getPath().toString())
