"""Cuts of the part graph, which are too many for SQL, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from wellcut.functions.criterion import Criterion
from wellcut.operators.graph import intra_cluster_edges
from wellcut.operators.mincut import adjacency, brute_force_cut, components, subgraph
from wellcut.operators.refine import wcc
from wellcut.plans.datasets import copurchase_inside, pairs_in_baskets, part_brands, part_copurchase, supplier_copurchase, supplier_nations
from wellcut.plans.queries import QUERIES, broken_rules

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_wcc_log10_cuts(spark):
    # a ring of four nodes passes; two cliques joined by an edge, and a leaf, have to be cut
    pairs = [(a, b) for low in (0, 10) for a in range(low, low + 8) for b in range(low, a)] + [(7, 10), (30, 31), (31, 32), (32, 33), (33, 30), (17, 20)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    c = spark.createDataFrame([(u, 1) for u in {u for p in pairs for u in p}], "node long, cluster_id int")
    found = {(r["node"], r["cluster_id"]) for r in wcc(e, c, "1log_10(n)", canonical=True).collect()}
    assert found == {(u, low) for low, n in ((0, 8), (10, 8), (30, 4)) for u in range(low, low + n)}


@pytest.mark.parametrize(("name", "text", "sf"), [("wcc_sqrt", "1n^0.5", MIDDLE), ("wcc_2log10_parts", "2log_10(n)", SMALL)])
def test_clusters_pass_by_brute_force(name, text, sf, spark):
    graph = (part_copurchase, part_brands) if "parts" in name else (supplier_copurchase, supplier_nations)
    e = intra_cluster_edges(*(f(spark, sf) for f in graph)).toPandas()
    adj, c = adjacency(e["src"].to_numpy(), e["dst"].to_numpy()), Criterion.parse(text)
    groups = {}
    for r in QUERIES[name](spark, sf).collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    for low, nodes in groups.items():
        sub = subgraph(adj, nodes)
        assert low == min(nodes) and len(components(sub)) == 1 and c.holds(len(nodes), brute_force_cut(sub))
    # a component that passes as it is stays whole
    whole = [set(x) for x in components(adj) if len(x) > 1 and c.holds(len(x), brute_force_cut(subgraph(adj, set(x))))]
    assert whole and all(groups.get(min(x)) == x for x in whole)


def test_cuts_of_parts_by_brute_force(spark):
    e = intra_cluster_edges(part_copurchase(spark, SMALL), part_brands(spark, SMALL)).toPandas()
    adj = adjacency(e["src"].to_numpy(), e["dst"].to_numpy())
    want = sorted((x[0], len(x), brute_force_cut(subgraph(adj, set(x)))) for x in components(adj))
    assert sorted(map(tuple, QUERIES["mincut_value_parts"](spark, SMALL).collect())) == want
    flags = {r["component"]: r for r in QUERIES["well_connected_flag_parts"](spark, SMALL).collect()}
    log, twice = Criterion.parse("1log_10(n)"), Criterion.parse("2log_10(n)")
    assert all((flags[k]["connected"], flags[k]["log10"], flags[k]["twice_log10"]) == (cut >= 1, log.holds(n, cut), twice.holds(n, cut)) for k, n, cut in want) and len(flags) == len(want)


def test_pairs_inside_brands_are_the_edges_inside_brands(spark):
    brands = part_brands(spark, SMALL)
    want = intra_cluster_edges(part_copurchase(spark, SMALL), brands).select("src", "dst", "weight").collect()
    got = copurchase_inside(spark, SMALL, brands).select("src", "dst", "weight").collect()
    assert sorted(got) == sorted(want) and got


def test_lines_are_read_and_shuffled_once(spark):
    plan = copurchase_inside(spark, SMALL, part_brands(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("lineitem.parquet") == 1 and "SortMergeJoin" not in plan


def test_pairs_in_baskets_by_brute_force():
    rng = random.Random(1)
    rows = [(rng.randrange(-20, 20), rng.randrange(4), rng.randrange(30)) for _ in range(400)] + [(99, 1, u) for u in range(40)] * 2
    # baskets and clusters that are mixed into one number
    step = pow(0x9E3779B97F4A7C15, -1, 1 << 64) * 0xC2B2AE3D27D4EB4F % (1 << 64)
    rows += [((1000 - c * step + (1 << 63)) % (1 << 64) - (1 << 63), c, u) for c in range(5) for u in (c, c + 1, 50)]
    rng.shuffle(rows)
    for some in (rows, rows[:1], rows[:2], [(1, 1, 1), (1, 1, 1)], [(1, 1, 1), (1, 2, 2)]):
        groups = {}
        for basket, cluster, u in some:
            groups.setdefault((basket, cluster), set()).add(u)
        want = sorted(p for us in groups.values() for p in combinations(sorted(us), 2))
        columns = (np.array(x, np.int64) for x in zip(*some, strict=True))
        got = [p for src, dst in pairs_in_baskets(*columns) for p in zip(src.tolist(), dst.tolist(), strict=True)]
        assert sorted(got) == want


def test_parts_twice_in_an_order_and_without_a_brand(spark, tmp_path):
    rows = [(1, 5), (1, 5), (1, 6), (1, 7), (2, 6), (2, 5), (3, 5), (3, None), (None, 5), (None, 6), (4, 9), (4, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = spark.createDataFrame([(5, 1), (6, 1), (7, 2), (8, 1), (9, None)], "node long, cluster_id int")
    # as the SQL joins them: lines without an order share none
    assert list(map(tuple, copurchase_inside(spark, str(tmp_path), c).collect())) == [(5, 6, 2.0)]


@pytest.mark.parametrize("name", ["cm_leiden_cpm", "cm_leiden_mod", "cm_louvain", "wcc_2log10_parts"])
def test_rules_read_the_edges_from_a_table_written_once(name, spark):
    found = QUERIES[f"rules_of_{name}"](spark, SMALL)
    assert "l_orderkey" not in found._jdf.queryExecution().toString()
    assert set(found.first()) == {0}


def test_rules_take_one_task_for_a_cluster(spark):
    plan = QUERIES["rules_of_cm_leiden_mod"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "p_brand" not in plan


def test_every_broken_rule_is_counted(spark):
    clique = lambda low, n: [(a, b) for a in range(low, low + n) for b in range(low, a)]
    pairs = [*clique(0, 5), *clique(10, 5), *clique(20, 5), *clique(30, 4), *clique(40, 4), (39, 40), (39, 41), *clique(50, 5), *clique(55, 6), (54, 55), (70, 71)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    c = spark.createDataFrame([(u, 1 if u < 22 else 2) for u in range(100)], "node long, cluster_id int")
    right = [(u, 0) for u in range(5)]
    misnamed, over_two, weak = [(u, 11) for u in range(10, 15)], [(u, 20) for u in range(20, 25)], [(u, 50) for u in range(50, 61)]
    in_parts = [(u, 30) for u in [*range(30, 34), *range(39, 44)]]
    one_node, unlinked_and_again = [(80, 80)], [(70, 70), (0, 70)]
    found = spark.createDataFrame(right + misnamed + over_two + weak + in_parts + one_node + unlinked_and_again, "node long, cluster long")
    row = broken_rules(found, e, c, "1log_10(n)").first().asDict()
    # node 0 makes its second cluster span two brands and start below its name; clusters without an edge are in parts, a cut of 0 is weak
    assert row == {"repeated": 1, "spanning": 2, "small_or_misnamed": 3, "in_parts": 3, "weak": 2}
    assert broken_rules(found, e, c, None).columns == ["repeated", "spanning", "small_or_misnamed", "in_parts"]
    assert set(broken_rules(spark.createDataFrame(right, found.schema), e, c, "1log_10(n)").first()) == {0}
