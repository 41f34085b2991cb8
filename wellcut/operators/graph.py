"""Relational graph operators: dictionaries, induced subgraphs, degrees, pair matrices, quality of a clustering.

Undirected edges are (src, dst[, weight]); the order of the ends means nothing, parallel edges count each, loops count
only where an operator says so. Clusterings are (node, cluster_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wellcut.session import Stored


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row: an equi-join on a constant."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge once from either end, without loops: one scan and no union of two reads."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.where("src <> dst").select(both.alias("e"), *extra).select("e.node", "e.other", *extra)


def with_default_weight(edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """Edges with a weight, ``weight`` where there is none."""
    found = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
    return edges.select("src", "dst", F.coalesce(found, F.lit(weight)).alias("weight"))


def graph_tables(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, dst, weight) and (node, size, self_weight) of edges and, where given, nodes(node[, size][, self_weight]).

    Weights and sizes are 1 and self weights those of a node's loops where there are none. Without nodes they are the ends of the
    edges; with nodes, one that comes up twice or is missing is an error.
    """
    e = with_default_weight(edges)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    given = ends if nodes is None else nodes
    if nodes is not None:
        if not nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError("a node comes up twice")
        if not ends.join(nodes, "node", "left_anti").isEmpty():
            raise ValueError("an edge has an end that is no node")
    own = lambda c: F.col(c).cast("double") if c in given.columns else F.lit(None).cast("double")
    loops = self_weights(e).withColumnRenamed("self_weight", "loops")
    rows = given.select("node", own("size").alias("size"), own("self_weight").alias("own")).join(loops, "node", "left")
    return e, rows.select("node", F.coalesce("size", F.lit(1.0)).alias("size"), F.coalesce("own", "loops", F.lit(0.0)).alias("self_weight"))


def last_wins(rows: DataFrame, order: str = "line") -> DataFrame:
    """(node, cluster_id): the row with the greatest ``order`` for each node."""
    return rows.groupBy("node").agg(F.max_by("cluster_id", order).alias("cluster_id"))


# dictionaries


def node_dictionary(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Dense ids 0.. in key order: (node, id). Ranges are sorted in parallel and numbered by a prefix sum of their counts."""
    ranked = nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct()
    return dense_numbers(ranked, ["node"], "id")


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows numbered 0.. in the order of distinct keys, without one task that sees them all.

    Rows are range-partitioned and numbered inside their partition; the partitions' offsets are sums of a few counts.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ranges come from a sample: they are written down so that every use sees the same ones
    parts = Stored(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges").df
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # one row for each partition
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__r", inside).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__first") + F.col("__r")).cast("long")).drop("__part", "__r", "__first")


def first_appearance_dictionary(edges: DataFrame, line: str = "line") -> DataFrame:
    """Dense ids in the order of first appearance, the source of a line before its target."""
    seen = edges.select(F.posexplode(F.array("src", "dst")).alias("pos", "node"), line)
    first = seen.groupBy("node").agg(F.min(F.struct(line, "pos")).alias("at")).select("node", F.col(f"at.{line}").alias("__line"), F.col("at.pos").alias("__pos"))
    return dense_numbers(first, ["__line", "__pos"], "id").select("node", "id")


def encode_edges(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names to ids; edges with an unknown end go."""
    ids = lambda end: dictionary.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(ids("src"), "src").join(ids("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *extra)


def encode_clusters(clusters: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names to ids; unknown nodes go."""
    return clusters.join(dictionary, "node").select(F.col("id").alias("node"), "cluster_id")


def decode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids back to names."""
    return rows.withColumnRenamed("node", "id").join(dictionary, "id").drop("id")


# filters and joins


def _ends(edges: DataFrame, clusters: DataFrame, how: str) -> DataFrame:
    side = lambda end: clusters.select(F.col("node").alias(end), F.col("cluster_id").alias(f"c_{end}"))
    return edges.join(side("src"), "src", how).join(side("dst"), "dst", how)


def intra_cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges with both ends in one cluster: (src, dst[, ...], cluster_id). The equality is part of the second join's key."""
    a = clusters.select(F.col("node").alias("src"), "cluster_id")
    b = clusters.select(F.col("node").alias("dst"), "cluster_id")
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, ["dst", "cluster_id"]).select("src", "dst", *extra, "cluster_id")


def inter_cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The other edges: ends in two clusters, or an end in none."""
    both = _ends(edges, clusters, "left")
    return both.where("NOT coalesce(c_src = c_dst, false)").drop("c_src", "c_dst")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(node)."""
    a, b = (nodes.select(F.col("node").alias(end)).distinct() for end in ("src", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end in nodes(node)."""
    a, b = (nodes.select(F.col("node").alias(end)).distinct() for end in ("src", "dst"))
    return edges.join(a, "src", "left_anti").join(b, "dst", "left_anti")


# aggregates


def node_degree(edges: DataFrame) -> DataFrame:
    """(node, degree) without loops; parallel edges count each."""
    return symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"))


def degree_one_nodes(edges: DataFrame, key: str | None = None) -> DataFrame:
    """The smallest node of degree one, of the graph or of each key."""
    keys = [key] if key else []
    ones = symmetric(edges).groupBy(*keys, "node").agg(F.count("*").alias("degree")).where("degree = 1")
    return ones.groupBy(*keys).agg(F.min("node").alias("node")).where("node IS NOT NULL")


def node_strength(edges: DataFrame) -> DataFrame:
    """(node, degree, strength): a loop counts twice at its node."""
    both = with_default_weight(edges).select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def directed_strength(edges: DataFrame) -> DataFrame:
    """(node, degree_in, degree_out, strength_in, strength_out) of edges taken from src to dst."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e")
    e = with_default_weight(edges).select(ends, "weight").select("e.node", "e.o", "weight")
    part = lambda o, v: F.sum(F.when(F.col("o") == o, v).otherwise(F.lit(0)))
    return e.groupBy("node").agg(
        part(0, F.lit(1)).alias("degree_in"), part(1, F.lit(1)).alias("degree_out"),
        part(0, F.col("weight")).cast("double").alias("strength_in"), part(1, F.col("weight")).cast("double").alias("strength_out"),
    )


def self_weights(edges: DataFrame) -> DataFrame:
    """(node, self_weight): weight of the loops at a node."""
    return with_default_weight(edges).where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("self_weight"))


def has_loops(edges: DataFrame) -> bool:
    return not edges.where("src = dst").isEmpty()


def incident_edges(edges: DataFrame, mode: str = "all") -> DataFrame:
    """(node, other, src, dst[, ...]): the edges out of each node, into it, or both; a loop counts at either end."""
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "all": [("src", "dst"), ("dst", "src")]}[mode]
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in ways])).alias("e")
    return edges.select(ends, *edges.columns).select("e.node", "e.other", *edges.columns)


def neighbours(edges: DataFrame, mode: str = "all") -> DataFrame:
    """(node, other): the nodes that edges lead to, come from, or both; parallel edges give a row each."""
    return incident_edges(edges, mode).select("node", "other")


def adjacency_list(edges: DataFrame) -> DataFrame:
    """(node, neighbours): ascending; parallel edges list a neighbour each. A row holds all of a node's; ``neighbours`` is the long form."""
    return symmetric(edges).groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def graph_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: n_nodes, n_edges, n_loops, total_weight."""
    e = with_default_weight(edges)
    every = nodes.select("node") if nodes is not None else e.select(F.explode(F.array("src", "dst")).alias("node"))
    n = every.agg(F.count_distinct("node").alias("n_nodes"))
    m = e.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("n_loops"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    return beside(n, m)


def possible_edges(n: Column, loops: bool = False) -> Column:
    pairs = n * (n - 1) / 2
    return pairs + n if loops else pairs


def graph_density(edges: DataFrame, nodes: DataFrame | None = None, loops: bool = False, directed: bool = False) -> DataFrame:
    """One row with density: twice the weight over n (n - 1), or n^2 with loops; directed without the factor 2."""
    s = graph_summary(edges, nodes)
    n = F.col("n_nodes").cast("double")
    room = n * n if loops else n * (n - 1)
    w = F.col("total_weight") * (1.0 if directed else 2.0)
    return s.select("n_nodes", "n_edges", "total_weight", F.when(room > 0, w / room).otherwise(F.lit(0.0)).alias("density"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def clustering_summary(clusters: DataFrame) -> DataFrame:
    """One row: n_clusters and n_nodes."""
    return clusters.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count_distinct("node").alias("n_nodes"))


def cluster_internal_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, n_edges) inside each cluster that has any."""
    return intra_cluster_edges(edges, clusters).groupBy("cluster_id").agg(F.count("*").alias("n_edges"))


def cluster_pair_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c1, c2, n_edges): the symmetric matrix of edges between clusters, the diagonal included."""
    both = _ends(edges, clusters, "inner").groupBy(F.least("c_src", "c_dst").alias("lo"), F.greatest("c_src", "c_dst").alias("hi")).agg(F.count("*").alias("n_edges"))
    ways = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("c1"), F.col("hi").alias("c2")))).otherwise(
        F.array(F.struct(F.col("lo").alias("c1"), F.col("hi").alias("c2")), F.struct(F.col("hi").alias("c1"), F.col("lo").alias("c2"))))
    return both.select(F.explode(ways).alias("w"), "n_edges").select("w.c1", "w.c2", "n_edges")


def sparse_cluster_pairs(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c1, c2, n_edges, ratio), c1 < c2: pairs joined by fewer edges than a quarter of those inside either, with the ratio to the
    sum of the edges inside, by which they are ranked."""
    matrix = cluster_pair_edges(edges, clusters)
    inside = matrix.where("c1 = c2")
    side = lambda c: inside.select(F.col("c1").alias(c), F.col("n_edges").alias(f"n_{c}"))
    both = matrix.where("c1 < c2").join(side("c1"), "c1").join(side("c2"), "c2")
    return both.where("n_c1 / 4 > n_edges AND n_c2 / 4 > n_edges").select("c1", "c2", "n_edges", (F.col("n_edges") / (F.col("n_c1") + F.col("n_c2"))).alias("ratio"))


def restore_inter_cluster_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges inside clusters, and those between the sparse pairs of clusters, once each."""
    pairs = sparse_cluster_pairs(edges, clusters).select(F.col("c1").alias("lo"), F.col("c2").alias("hi"))
    both = _ends(edges, clusters, "inner").withColumn("lo", F.least("c_src", "c_dst")).withColumn("hi", F.greatest("c_src", "c_dst"))
    inside = both.where("lo = hi").select(*edges.columns)
    return inside.unionByName(both.join(pairs, ["lo", "hi"], "left_semi").select(*edges.columns))


def collapse_graph(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The graph of clusters: (src, dst, weight), src <= dst, weights summed; loops hold the weight inside a cluster."""
    both = _ends(with_default_weight(edges), clusters, "inner")
    return both.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def collapsed_sizes(clusters: DataFrame) -> DataFrame:
    """Node sizes of the graph of clusters."""
    size = F.sum("size") if "size" in clusters.columns else F.count("*").cast("double")
    return clusters.groupBy(F.col("cluster_id").alias("node")).agg(size.alias("size"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: sum over clusters of w_c / m - (K_c / 2m)^2, over the weights of all edges."""
    e = with_default_weight(edges)
    total = e.agg(F.sum("weight").alias("m"))
    inside = intra_cluster_edges(e, clusters).groupBy("cluster_id").agg(F.sum("weight").alias("w"))
    strength = node_strength(e).join(clusters, "node").groupBy("cluster_id").agg(F.sum("strength").alias("k"))
    both = beside(strength.join(inside, "cluster_id", "left"), total)
    return both.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def cpm_quality(edges: DataFrame, clusters: DataFrame, resolution: float = 0.01) -> DataFrame:
    """One row: sum over clusters of w_c - resolution * n_c (n_c - 1) / 2."""
    inside = intra_cluster_edges(with_default_weight(edges), clusters).groupBy("cluster_id").agg(F.sum("weight").alias("w"))
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"))
    both = sizes.join(inside, "cluster_id", "left")
    return both.agg(F.sum(F.coalesce("w", F.lit(0.0)) - F.lit(resolution) * F.col("n") * (F.col("n") - 1) / 2).alias("cpm"))


def cluster_partition_assignment(clusters: DataFrame, parts: int) -> DataFrame:
    """(cluster_id, part): clusters numbered by id and dealt in contiguous blocks of equal size."""
    ids = dense_numbers(clusters.select("cluster_id").distinct(), ["cluster_id"], "idx")
    size = ids.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(parts))).alias("size"))
    return beside(ids, size).select("cluster_id", F.floor(F.col("idx") / F.col("size")).cast("long").alias("part"))


# numbering


def renumber(clusters: DataFrame) -> DataFrame:
    """(node, cluster_id): ids 0.. without gaps, in the order of each cluster's smallest node."""
    low = clusters.groupBy("cluster_id").agg(F.min("node").alias("low"))
    ids = dense_numbers(low, ["low"], "new").select("cluster_id", "new")
    return clusters.join(ids, "cluster_id").select("node", F.col("new").alias("cluster_id"))


def displacements(counts: DataFrame) -> DataFrame:
    """(rank, n) with the exclusive prefix sum ``first``; a row for each rank, so one small window."""
    w = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))


def order_communities(rows: DataFrame) -> DataFrame:
    """(id, size, third) by size, then third, both falling, then id."""
    return rows.orderBy(F.desc("size"), F.desc("third"), F.asc("id"))


def kl(q: Column, p: Column) -> Column:
    """Binary Kullback-Leibler divergence; a part counts only where its logarithm is defined."""
    a = F.when((q > 0) & (p > 0), q * F.log(q / p)).otherwise(F.lit(0.0))
    b = F.when((q < 1) & (p < 1), (1 - q) * F.log((1 - q) / (1 - p))).otherwise(F.lit(0.0))
    return a + b


def kll(q: Column, p: Column) -> Column:
    """The divergence, negative where q < p."""
    return F.when(q < p, -kl(q, p)).otherwise(kl(q, p))
