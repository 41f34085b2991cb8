"""Components of an edge stream, kept up to date in micro-batches.

The state is the forest (node, component) of the edges so far: new edges are joined to it and the components of that
much smaller graph are found again. Each batch writes a new version, named by its number, before older ones go, so a
batch that runs again after a failure starts from the same state and gives the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wellcut.operators.components import components_by_star


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(node, component) of the newest version before ``version`` (of all where None); None if there is none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "version" not in rows.columns:
        return None
    rows = rows if version is None else rows.where(F.col("version") < version)
    last = rows.agg(F.max("version")).first()[0]
    return None if last is None else rows.where(F.col("version") == last).select("node", "component")


def absorb(edges: DataFrame, state: DataFrame | None) -> DataFrame:
    """(node, component) after more edges(src, dst)."""
    if state is not None:
        edges = edges.select("src", "dst").unionByName(state.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    return components_by_star(edges)


def start_components(edges: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a query that keeps the components of a stream of edges(src, dst) under ``path``."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        absorb(rows, read_state(spark, path, number)).write.mode("overwrite").parquet(f"{path}/version={number}")
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(old):
            fs.delete(old, True)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
