"""Every query with SQL against DuckDB; plans; invariants of the others."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wellcut.functions.criterion import Criterion
from wellcut.operators.graph import intra_cluster_edges, kl, kll
from wellcut.operators.mincut import adjacency, components, global_min_cut
from wellcut.plans.datasets import part_brands, part_copurchase
from wellcut.plans.queries import QUERIES
from wellcut.plans.sql import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["wcc_copurchase", "cm_leiden_cpm", "cm_leiden_mod", "cm_louvain"])
def test_clusters_are_well_connected(name, spark):
    e = intra_cluster_edges(part_copurchase(spark, SF), part_brands(spark, SF)).toPandas()
    brand = {r["node"]: r["cluster_id"] for r in part_brands(spark, SF).collect()}
    adj, c = adjacency(e["src"].to_numpy(), e["dst"].to_numpy()), Criterion.parse("1log_10(n)")
    groups = {}
    for r in QUERIES[name](spark, SF).collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    nodes = [u for g in groups.values() for u in g]
    assert nodes and len(nodes) == len(set(nodes))
    for low, g in groups.items():
        sub = {u: {v: w for v, w in adj[u].items() if v in g} for u in g}
        assert min(g) == low and len(g) > 1 and len({brand[u] for u in g}) == 1 and len(components(sub)) == 1
        assert c.holds(len(g), global_min_cut(sub)[0])


def test_communities_are_better_than_singletons_and_repeat(spark):
    from wellcut.operators.community import cluster_graph
    from wellcut.operators.graph import modularity

    e = intra_cluster_edges(part_copurchase(spark, SF), part_brands(spark, SF)).select("src", "dst", "weight").cache()
    best = {}
    for a in ("leiden-mod", "louvain"):
        found = cluster_graph(e, a).cache()
        assert sorted(found.collect()) == sorted(cluster_graph(e, a).collect())
        best[a] = modularity(e, found).first()[0]
    assert min(best.values()) > 0.9  # 25 brands of equal size alone give 0.96
    with pytest.raises(ValueError):
        cluster_graph(e, "other")


def test_scan_is_pruned(spark):
    plan = part_copurchase(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_kl_of_equal_and_extreme(spark):
    from pyspark.sql import functions as F

    r = spark.sql("SELECT 0.5D a, 0.5D b, 0D z, 1D o, 0.2D l").select(kl(F.col("a"), F.col("b")), kl(F.col("z"), F.col("l")), kl(F.col("o"), F.col("l")), kll(F.col("l"), F.col("a"))).first()
    assert r[0] == 0 and abs(r[1] - 0.22314355) < 1e-6 and abs(r[2] - 1.6094379) < 1e-6 and r[3] < 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "cluster"]
