"""Graphs and clusterings derived from the provided tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellcut.session import table


def _copurchase(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(src, dst, weight), src < dst: pairs that share an order, with the number of orders they share."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(column).alias("u")).distinct()
    # an order has a handful of lines: pairs are made inside it
    baskets = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("u")).alias("us")).where(F.size("us") > 1)
    pairs = F.explode(F.flatten(F.transform("us", lambda u, i: F.transform(F.slice("us", i + 2, F.size("us")), lambda v: F.struct(u.alias("src"), v.alias("dst"))))))
    return baskets.select(pairs.alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").cast("double").alias("weight"))


def part_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copurchase(spark, sf_dir, "l_partkey")


def pairs_in_baskets(basket: np.ndarray, cluster: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(src, dst), src < dst: the pairs of different nodes with one basket and cluster, each once for a basket and cluster.

    Rows are sorted by a hash first, which is fast; only those whose hash comes up again are sorted by what they hold.
    """
    mixed, other = basket.astype(np.uint64), cluster.astype(np.uint64)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    other *= np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += other
    del other
    order = np.argsort(mixed)
    mixed = mixed[order]
    again = mixed[1:] == mixed[:-1]
    rows = order[np.append(again, False) | np.insert(again, 0, False)]
    rows = rows[np.lexsort((node[rows], cluster[rows], basket[rows]))]
    basket, cluster, node = basket[rows], cluster[rows], node[rows]
    fresh = (basket[1:] != basket[:-1]) | (cluster[1:] != cluster[:-1])
    kept = np.insert(fresh | (node[1:] != node[:-1]), 0, True)[: len(rows)]
    group, node = np.cumsum(np.insert(fresh, 0, True)[: len(rows)])[kept], node[kept]
    first, apart = np.arange(len(node)), 0
    while len(first):
        apart += 1
        first = first[: np.searchsorted(first, len(node) - apart)]
        first = first[group[first] == group[first + apart]]
        yield node[first], node[first + apart]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        columns = [np.concatenate([b.column(name).to_numpy() for b in held]) for name in ("basket", "cluster", "node")]
        held.clear()
        for pairs in pairs_in_baskets(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["src", "dst"])


def copurchase_inside(spark: SparkSession, sf_dir: str, clusters: DataFrame) -> DataFrame:
    """The edges of part_copurchase with both ends in one cluster, for clusters(node, cluster_id) with a row for each part.

    Lines meet by order and cluster, so pairs of two clusters, which are most, are neither made nor shuffled. A task takes about
    65 bytes for each line of its partition.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("node"))
    items = lines.join(clusters, "node").where("basket IS NOT NULL AND cluster_id IS NOT NULL")
    items = items.select("basket", F.col("cluster_id").cast("long").alias("cluster"), "node")
    pairs = items.repartition("basket", "cluster").mapInArrow(_pairs, "src long, dst long")  # the one shuffle of lines
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def supplier_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copurchase(spark, sf_dir, "l_suppkey")


def brand_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part edges inside brands, and those between brands that join two parts of a size up to 17.

    Between brands there are then about as many edges as a quarter of those inside one, at every scale: some pairs of
    brands are sparse and some aren't, where all edges of random orders would leave none sparse.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    side = lambda end: parts.select(F.col("p_partkey").alias(end), F.col("p_brand").alias(f"b_{end}"), F.col("p_size").alias(f"s_{end}"))
    both = part_copurchase(spark, sf_dir).join(side("src"), "src").join(side("dst"), "dst")
    return both.where("b_src = b_dst OR (s_src <= 17 AND s_dst <= 17)").select("src", "dst", "weight")


def part_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, cluster_id): parts by the number of their brand."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("cluster_id"))


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("int").alias("cluster_id"))
