"""The shared folder: tables written there cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one, kept for the application, but only if the
    master is local too: on a cluster other machines would not see it."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = _LOCAL.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        _LOCAL[spark.sparkContext.applicationId] = there
    return there.rstrip("/")


#: Rows in a batch of texts for Python workers, whose memory holds a few batches at a time.
BATCH_ROWS, _BATCH = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: use BATCH_ROWS unless the session has a setting of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that df has no column of, in whatever letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """A new folder inside the shared one. Tables in it are written once and read many times."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
        """Write df as Parquet and return a DataFrame that reads it back. Most such tables are names, hashes and counts,
        which hardly shrink, and no codec means no native buffers."""
        path = self.at(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, self.at(name))


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system and Path object of path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
