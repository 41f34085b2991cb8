"""Queries over graphs of the provided tables, one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellcut.functions.criterion import Criterion, connected
from wellcut.operators import graph as g
from wellcut.operators.community import cluster_graph
from wellcut.operators.components import union_find
from wellcut.operators.mincut import adjacency, global_min_cut, min_cut_sides, min_cuts
from wellcut.operators.refine import cc, cm, connected_components, wcc, wcc_rounds
from wellcut.plans.datasets import brand_graph, copurchase_inside, part_brands, part_copurchase, supplier_copurchase, supplier_nations
from wellcut.session import Stored, dealt, shared_dir, table
from wellcut.sources import io
from wellcut.telemetry import totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _node_cluster(df: DataFrame) -> DataFrame:
    return df.select("node", F.col("cluster_id").cast("long").alias("cluster"))


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers of a nation that share an order."""
    return supplier_copurchase(spark, sf_dir), supplier_nations(spark, sf_dir)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of a brand that share an order."""
    return part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)


def _brand_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same for operators that use no edge between brands."""
    brands = part_brands(spark, sf_dir)
    return copurchase_inside(spark, sf_dir, brands), brands


def _component_edges(e: DataFrame, c: DataFrame) -> DataFrame:
    inside = g.intra_cluster_edges(e, c)
    return inside.join(connected_components(e, c).select(F.col("node").alias("src"), "component"), "src").select("component", "src", "dst")


def _flags(edges: DataFrame) -> DataFrame:
    named = {"log10": "1log_10(n)", "twice_log10": "2log_10(n)"}
    flags = [Criterion.parse(c).column("n_nodes", "cut_size").alias(k) for k, c in named.items()]
    return min_cuts(edges).select("component", "n_nodes", "cut_size", connected("cut_size").alias("connected"), *flags)


# relational operators


@query
def node_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_copurchase(spark, sf_dir)
    return g.node_dictionary(e.select(F.explode(F.array("src", "dst")).alias("node")))


@query
def encoded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_copurchase(spark, sf_dir)
    named = e.select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"))
    d = g.node_dictionary(e.select(F.explode(F.array("src", "dst")).alias("node"))).select(F.concat(F.lit("p"), "node").alias("node"), "id")
    return g.encode_edges(named, d)


@query
def decoded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("node"), F.col("s_suppkey").alias("id"))
    return g.decode(supplier_nations(spark, sf_dir), d).select("node", "cluster_id")


@query
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line"))
    return g.last_wins(rows)


@query
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.graph_summary(part_copurchase(spark, sf_dir))


@query
def clustering_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.clustering_summary(part_brands(spark, sf_dir))


@query
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.node_degree(part_copurchase(spark, sf_dir))


@query
def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.node_strength(part_copurchase(spark, sf_dir))


@query
def directed_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.directed_strength(part_copurchase(spark, sf_dir))


@query
def self_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.self_weights(g.collapse_graph(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)))


@query
def adjacency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.adjacency_list(part_copurchase(spark, sf_dir)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query
def out_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.neighbours(part_copurchase(spark, sf_dir), "out")


@query
def in_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.neighbours(part_copurchase(spark, sf_dir), "in")


@query
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.incident_edges(supplier_copurchase(spark, sf_dir))


@query
def intra_cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.intra_cluster_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst", "cluster_id")


@query
def inter_cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.inter_cluster_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst")


@query
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return g.induced_subgraph(part_copurchase(spark, sf_dir), nodes).select("src", "dst")


@query
def deleted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    return g.without_nodes(part_copurchase(spark, sf_dir), nodes).select("src", "dst")


@query
def degree_one_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degree_one_nodes(_component_edges(*_parts(spark, sf_dir)), "component")


@query
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.component_sizes(connected_components(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)))


@query
def cluster_internal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cluster_internal_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir))


@query
def cluster_pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cluster_pair_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir))


@query
def sparse_cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.sparse_cluster_pairs(brand_graph(spark, sf_dir), part_brands(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query
def restored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.restore_inter_cluster_edges(brand_graph(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst")


@query
def collapse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.collapse_graph(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir))


@query
def collapsed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.collapsed_sizes(part_brands(spark, sf_dir))


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the graph of brands, with sizes and the weight of their loops."""
    e, c = _parts(spark, sf_dir)
    return g.graph_tables(g.collapse_graph(e, c), g.collapsed_sizes(c))[1]


@query
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.graph_density(part_copurchase(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query
def density_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of brands, which has loops: density with and without them, directed and not, with the number of possible edges."""
    e = g.collapse_graph(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir))
    one = lambda loops, directed: g.graph_density(e, None, loops, directed).select(F.lit(loops).alias("loops"), F.lit(directed).alias("directed"), "n_nodes", g.possible_edges(F.col("n_nodes"), loops).cast("double").alias("possible"), F.round("density", 9).alias("density"))
    rows = [one(loops, directed) for loops in (False, True) for directed in (False, True)]
    return reduce(DataFrame.unionByName, rows)


@query
def ordered_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by size, then the greatest part size, then number, with their place."""
    rows = table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("id")).agg(F.count("*").alias("size"), F.max("p_size").alias("third"))
    ordered = g.order_communities(rows)
    return g.dense_numbers(ordered.withColumn("falling", F.struct(-F.col("size"), -F.col("third"), "id")), ["falling"], "place").drop("falling")


@query
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.modularity(part_copurchase(spark, sf_dir).drop("weight"), part_brands(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query
def cpm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cpm_quality(part_copurchase(spark, sf_dir).drop("weight"), part_brands(spark, sf_dir), 0.01).select(F.round("cpm", 6).alias("cpm"))


@query
def cluster_partition_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cluster_partition_assignment(part_brands(spark, sf_dir), 4)


@query
def rank_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.displacements(part_brands(spark, sf_dir).groupBy(F.col("cluster_id").alias("rank")).agg(F.count("*").alias("n")))


@query
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discount of a line against its tax, as two probabilities."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.kl(F.col("l_discount"), F.col("l_tax")).alias("kl"), g.kll(F.col("l_discount"), F.col("l_tax")).alias("kll"))
    return rows.groupBy("l_linenumber").agg(F.round(F.sum("kl"), 4).alias("kl"), F.round(F.sum("kll"), 4).alias("kll"))


@query
def telemetry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by routine, over the events taken as telemetry rows."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("stage"), F.col("event_type").alias("op"), F.col("value").alias("wall_s"), F.length("props").cast("long").alias("bytes"))
    return totals(rows).withColumn("wall_s", F.round("wall_s", 4))


@query
def criterion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every criterion on sizes and cuts taken from the parts."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"), (F.col("p_size") % 6).cast("long").alias("cut"))
    named = {"log10": "1log_10(n)", "log2": "log_2(n)", "twice_log10": "2log_10(n)", "sqrt": "0.1n^0.5", "simple": "0"}
    return rows.select("n", "cut", *[Criterion.parse(c).column("n", "cut").alias(k) for k, c in named.items()])


# components, cuts and the three queries


@query
def connected_components_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir), strategy="task")


@query
def connected_components_by_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir), strategy="star")


@query
def mincut_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_cuts(_component_edges(*_suppliers(spark, sf_dir))).select("component", "n_nodes", "cut_size")


@query
def mincut_value_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_cuts(_component_edges(*_parts(spark, sf_dir))).select("component", "n_nodes", "cut_size")


@query
def cut_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of the minimum cuts: 0 is the smaller one, of the smallest node in a tie."""
    return min_cut_sides(_component_edges(*_suppliers(spark, sf_dir)))


@query
def well_connected_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_component_edges(*_suppliers(spark, sf_dir)))


@query
def well_connected_flag_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_component_edges(*_parts(spark, sf_dir)))


@query
def cc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(cc(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir), canonical=True))


@query
def cc_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(cc(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)))


@query
def wcc_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(wcc(*_suppliers(spark, sf_dir), "1log_10(n)", canonical=True))


@query
def wcc_2log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(wcc(*_suppliers(spark, sf_dir), "2log_10(n)", canonical=True))


@query
def wcc_2log10_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(wcc_rounds(*_suppliers(spark, sf_dir), "2log_10(n)", canonical=True)[0])


@query
def wcc_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(wcc(*_suppliers(spark, sf_dir), "1n^0.5", canonical=True))


@query
def wcc_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_cluster(wcc(*_parts(spark, sf_dir), "1log_10(n)", canonical=True))


@query
def wcc_2log10_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REFINED["wcc_2log10_parts"](*_brand_parts(spark, sf_dir))


@query
def leiden_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.intra_cluster_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst", "weight")
    return _node_cluster(cluster_graph(e, "leiden-cpm", 0.05))


@query
def leiden_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.intra_cluster_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst", "weight")
    return _node_cluster(cluster_graph(e, "leiden-mod"))


@query
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.intra_cluster_edges(part_copurchase(spark, sf_dir), part_brands(spark, sf_dir)).select("src", "dst", "weight")
    return _node_cluster(cluster_graph(e, "louvain"))


def _cm(algorithm: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda e, c: _node_cluster(cm(e, c, algorithm, 0.05, canonical=True))


#: What is found from edges and clusters, for the queries and for the rules of their results.
REFINED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "wcc_2log10_parts": lambda e, c: _node_cluster(wcc(e, c, "2log_10(n)", canonical=True)),
    "cm_leiden_cpm": _cm("leiden-cpm"),
    "cm_leiden_mod": _cm("leiden-mod"),
    "cm_louvain": _cm("louvain"),
}


def _refined(name: str) -> Query:
    return lambda spark, sf_dir: REFINED[name](*_brand_parts(spark, sf_dir))


QUERIES |= {name: _refined(name) for name in ("cm_leiden_cpm", "cm_leiden_mod", "cm_louvain")}


# what holds of every result, however ties and random moves fall


def _measured(inside: DataFrame, cuts: bool) -> DataFrame:
    """(cluster, reached, parts, n_nodes, cut_size): the nodes and components of the edges inside each cluster and, where asked
    for, the minimum cut: all in one task."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        nodes, comp = union_find(src, dst)
        adj = adjacency(src, dst) if cuts else {}
        cut, _ = global_min_cut(adj) or (0, [])
        return pd.DataFrame({"cluster": pdf["cluster_id"].iloc[:1], "reached": [len(nodes)], "parts": [len(np.unique(comp))], "n_nodes": [len(adj)], "cut_size": [cut]})

    rows = inside.select("cluster_id", "src", "dst")
    rows = dealt(rows, "cluster_id") if cuts else rows
    return rows.groupBy("cluster_id").applyInPandas(solve, "cluster long, reached long, parts long, n_nodes long, cut_size long")


def broken_rules(found: DataFrame, edges: DataFrame, clusters: DataFrame, criterion: str | None) -> DataFrame:
    """One row of counts that are 0 for a right result found(node, cluster) of edges and clusters: nodes in two clusters, clusters
    that span two of the given ones, of one node, in parts, or with a minimum cut that doesn't pass."""
    rows = Stored(found, "rules").df
    inside = g.intra_cluster_edges(edges, rows.withColumnRenamed("cluster", "cluster_id"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("node").alias("low"))
    whole = sizes.join(_measured(inside, criterion is not None), "cluster", "left")
    wrong = {"small_or_misnamed": F.expr("size < 2 OR low <> cluster"), "in_parts": F.expr("coalesce(parts, 0) <> 1 OR reached <> size")}
    if criterion:
        wrong["weak"] = ~Criterion.parse(criterion).column("n_nodes", "cut_size")
    bad = [
        rows.groupBy("node").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated")),
        rows.join(clusters, "node").groupBy("cluster").agg((F.min("cluster_id") < F.max("cluster_id")).alias("two")).agg(F.count_if("two").alias("spanning")),
        whole.agg(*[F.count_if(is_wrong).alias(name) for name, is_wrong in wrong.items()]),
    ]
    return reduce(g.beside, bad)


def _rules(name: str, criterion: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Stored(part_brands(spark, sf_dir), "clusters").df
        e = copurchase_inside(spark, sf_dir, c)
        if name in REFINED:
            e = Stored(e, "edges").df
            found = REFINED[name](e, c)
        else:
            found = QUERIES[name](spark, sf_dir)
        if not criterion:  # communities keep nodes that are alone
            sizes = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
            found = found.join(sizes, "cluster", "left_semi").select("node", "cluster")
        return broken_rules(found, e, c, criterion)

    return run


RULED = {"wcc_2log10_parts": "2log_10(n)", "cm_leiden_cpm": "1log_10(n)", "cm_leiden_mod": "1log_10(n)", "cm_louvain": "1log_10(n)", "leiden_cpm": None, "leiden_mod": None}
QUERIES |= {f"rules_of_{name}": _rules(name, criterion) for name, criterion in RULED.items()}


# readers and writers: tables written to files in the shared folder and read again


def _written(df: DataFrame, name: str) -> str:
    """A folder of one text file with the rows of df(value) in the order of its other columns."""
    path = f"{shared_dir(df.sparkSession)}/wellcut/{name}-{uuid.uuid4().hex}"
    others = [c for c in df.columns if c != "value"]
    df.repartition(1).sortWithinPartitions(*others).select("value").write.text(path)
    return path


def _edge_file(spark: SparkSession, sf_dir: str, sep: str, weighted: bool = False) -> str:
    name = lambda end: F.concat(F.lit("s"), F.col(end).cast("string"))
    e = supplier_copurchase(spark, sf_dir)
    fields = [name("src"), name("dst"), *([F.col("weight").cast("string")] if weighted else [])]
    return _written(e.select("src", "dst", F.concat_ws(sep, *fields).alias("value")), "edges")


def _cluster_file(spark: SparkSession, sf_dir: str, named: bool = True) -> str:
    """Suppliers by the part they sold, in the order of the lines: a supplier comes up often, with other clusters."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" ", F.concat(F.lit("s" if named else ""), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string")).alias("value"))
    return _written(rows, "clusters")


@query
def sniffed_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, io.sniff_delimiter(spark, _edge_file(spark, sf_dir, sep))) for name, sep in (("comma", ","), ("tab", "\t"), ("space", "   "))]
    return spark.createDataFrame(found, "file string, delimiter string")


@query
def read_edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_edges(spark, _edge_file(spark, sf_dir, "   "))[0].select("src", "dst")


@query
def read_edge_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of first appearance."""
    return io.read_edges(spark, _edge_file(spark, sf_dir, ","))[1].select("node", "id")


@query
def read_weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_edges(spark, _edge_file(spark, sf_dir, " ", True), weighted=True)[0].select("src", "dst", "weight")


@query
def read_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_clustering(spark, _cluster_file(spark, sf_dir))


@query
def read_cluster_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_clustering_ints(spark, _cluster_file(spark, sf_dir, False))


@query
def read_clusters_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_clustering_reindexed(spark, _cluster_file(spark, sf_dir))


@query
def encoded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the suppliers by id; suppliers in no order of two suppliers are unknown and go."""
    _, dictionary = io.read_edges(spark, _edge_file(spark, sf_dir, "\t"))
    named = supplier_nations(spark, sf_dir).select(F.concat(F.lit("s"), F.col("node").cast("string")).alias("node"), "cluster_id")
    return g.encode_clusters(named, dictionary)


@query
def written_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wellcut/written-{uuid.uuid4().hex}"
    io.write_clusters(part_brands(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="node_id long, cluster_id long")


@query
def written_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wellcut/map-{uuid.uuid4().hex}"
    io.write_partition_map(part_brands(spark, sf_dir), path)
    return spark.read.csv(path, schema="node long, cluster_id int")
