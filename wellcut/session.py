"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(name: str = "wellcut", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``master`` only for local runs and tests."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by keys to spark.sql.shuffle.partitions partitions, however few bytes they are.

    For grouped maps that take long for their size: adaptive execution would put small partitions into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error, because a
    machine-local folder would lose data with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL_DIR
    if not _LOCAL_DIR:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="wellcut-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return f"file://{_LOCAL_DIR}"


_LOCAL_DIR = ""


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A table written once to the shared folder: cuts lineage and survives the loss of executors."""

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/wellcut/{name}-{uuid.uuid4().hex}"
        # row groups of 16 MB: a writer holds one in memory
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def size(self) -> int:
        """Bytes of the files."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    return Stored(df, name).df
