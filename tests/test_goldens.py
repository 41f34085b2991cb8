"""Small graphs with results worked out by hand or by trying every minimum cut, with and without the loss of the first line."""

import pytest
from test_fixtures import partition, write

from wellcut.operators.refine import cc, wcc, wcc_rounds
from wellcut.sources import io

# Edges, clusters (node to cluster) and goldens.
SIMPLE = "0 1;0 2;0 4;0 5;0 6;0 7;1 2;1 3;1 8;1 9;1 10;2 3;3 1;3 12;3 11;12 13;14 15;14 17;14 19;19 17;19 18;17 18;17 16"
BLOBS = "1 2;2 3;3 1;4 1;4 2;5 4;5 2;5 3;10 11;10 12;10 13;10 14;11 12;11 13;11 14;12 13;12 14;13 14;20 21;21 22;22 23;23 24;24 25;21 23;21 24;21 25;22 24;22 25;23 25;1 10;1 11;1 25"
PARTS = "1 2;2 3;3 1;4 1;4 2;5 4;5 2;5 3;10 11;11 13;13 10;20 21;21 22;22 23;23 24;24 25;21 23;21 24;21 25;22 24;22 25;23 25;1 25"
CLIQUE = ";".join([f"{a} {b}" for a in range(1, 11) for b in range(a + 1, 11)] + ["100 101", "101 103", "103 100", "1 900"])
IN_200 = {3, *range(11, 20)}
A, B, C, D = [1, 2, 3, 4, 5], [10, 11, 12, 13, 14], [21, 22, 23, 24, 25], [10, 11, 13]
SIMPLE_CC = [[0, 1, 2, 4, 5, 6, 7, 8, 9, 10], [3, 11, 12, 13], [14, 15, 16, 17, 18, 19]]
LOG, TWICE, ROOT, LOG2 = "1log_10(n)", "2log_10(n)", "1n^0.5", "1log_2(n)"
#: name, edges, first line lost, nodes, edges, edges inside clusters, components, result for each criterion that has a single one
CASES = [
    ("simple", SIMPLE, True, 20, 22, 19, SIMPLE_CC, {LOG: SIMPLE_CC, TWICE: [[1, 9, 10], [3, 12, 13], [14, 17, 18, 19]]}),
    ("simple", SIMPLE, False, 20, 23, 20, SIMPLE_CC, {LOG: SIMPLE_CC, TWICE: [[0, 1, 2], [3, 12, 13], [14, 17, 18, 19]]}),
    ("blobs", BLOBS, True, 16, 31, 31, [sorted([*A, *B, 20, *C])], {LOG: [[*A, *B], C], TWICE: [[*A, *B], C]}),
    ("blobs", BLOBS, False, 16, 32, 32, [sorted([*A, *B, 20, *C])], {LOG: [[*A, *B], C], TWICE: [[*A, *B], C], ROOT: [A, B, C], LOG2: [A, B, C]}),
    ("parts", PARTS, True, 14, 22, 22, [[*A, 20, *C], D], {LOG: [[*A, *C], D], TWICE: [A, D, C]}),
    ("parts", PARTS, False, 14, 23, 23, [[*A, 20, *C], D], {LOG: [[*A, *C], D], TWICE: [A, D, C], ROOT: [A, D, C], LOG2: [A, D, C]}),
    ("clique", CLIQUE, False, 14, 49, 49, [[*range(1, 11), 900], [100, 101, 103]], {LOG: [[*range(1, 11)], [100, 101, 103]], TWICE: [[*range(1, 11)], [100, 101, 103]], ROOT: [[*range(1, 11)], [100, 101, 103]], LOG2: [[*range(1, 11)], [100, 101, 103]]}),
]


@pytest.mark.parametrize(("name", "text", "skip", "n_nodes", "n_edges", "n_inside", "whole", "cut"), CASES)
def test_goldens(spark, tmp_path, name, text, skip, n_nodes, n_edges, n_inside, whole, cut):
    pairs = [tuple(map(int, x.split())) for x in text.split(";")]
    rows = [(u, 200 if name == "simple" and u in IN_200 else 100) for u in dict.fromkeys(u for p in pairs for u in p)] + [(43, 100)]
    edges, clusters, d = io.load(spark, write(tmp_path, "e", pairs), write(tmp_path, "c", rows, "\t"), compat_first_line_skip=skip)
    inside = edges.join(clusters.withColumnRenamed("node", "src"), "src").join(clusters.select(clusters.node.alias("dst"), clusters.cluster_id.alias("other")), "dst").where("cluster_id = other")
    assert (d.count(), edges.count(), inside.count()) == (n_nodes, n_edges, n_inside)
    assert partition(cc(edges, clusters), d) == sorted(whole)
    for criterion, want in cut.items():
        assert partition(wcc(edges, clusters, criterion), d) == sorted(want), criterion
    assert partition(wcc_rounds(edges, clusters, TWICE)[0], d) == sorted(cut[TWICE])


def test_pairs_of_clusters_by_hand(spark):
    """Inside 1, 2 and 3: 9, 10 and 5 edges. Between 1 and 2: 2, less than 9/4. Between 1 and 3: 2, not less than 5/4. Between 2 and 3: 1."""
    from wellcut.operators.graph import restore_inter_cluster_edges, sparse_cluster_pairs

    inside = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)][1:] + [(a, b) for a in range(11, 16) for b in range(a + 1, 16)] + [(21, 22), (22, 23), (23, 24), (24, 25), (25, 21)]
    between = [(1, 11), (2, 12), (1, 21), (2, 22), (13, 23)]
    e = spark.createDataFrame(inside + between, "src long, dst long")
    c = spark.createDataFrame([(u, u // 10) for u in {u for p in inside for u in p}], "node long, cluster_id int")
    assert [(r["c1"], r["c2"], r["n_edges"], round(r["ratio"], 9)) for r in sparse_cluster_pairs(e, c).orderBy("c1", "c2").collect()] == [(0, 1, 2, round(2 / 19, 9)), (1, 2, 1, round(1 / 15, 9))]
    assert sorted(map(tuple, restore_inter_cluster_edges(e, c).collect())) == sorted(inside + [(1, 11), (2, 12), (13, 23)])


def test_lines_of_a_folder_follow_its_files(spark, tmp_path):
    """Spark reads the largest file first; the last row of a node and first appearance follow the names."""
    (tmp_path / "a").write_text("x 1\n")
    (tmp_path / "b").write_text("y 2\n" + "x 5\n" * 3000)
    (tmp_path / "c").write_text("x 7\nz 3\n")
    assert {r["node"]: r["cluster_id"] for r in io.read_clustering(spark, str(tmp_path)).collect()} == {"x": 7, "y": 2, "z": 3}
    assert [r["node"] for r in io.read_edges(spark, str(tmp_path))[1].orderBy("id").collect()] == ["x", "1", "y", "2", "5", "7", "z", "3"]


def test_rounds_that_run_out_are_an_error(spark):
    e = spark.createDataFrame([(a, b) for low in (0, 10) for a in range(low, low + 8) for b in range(low, a)] + [(7, 10)], "src long, dst long")
    c = spark.createDataFrame([(u, 1) for u in [*range(8), *range(10, 18)]], "node long, cluster_id int")
    found, steps = wcc_rounds(e, c)
    assert found.count() == 16 and all(s["bytes"] > 0 for s in steps)
    with pytest.raises(RuntimeError, match="1 rounds"):
        wcc_rounds(e, c, max_rounds=1)


def test_graph_tables(spark):
    from wellcut.operators.graph import graph_tables

    e = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 3, 4.0)], "src long, dst long, weight double")
    edges, nodes = graph_tables(e)
    assert sorted(r["weight"] for r in edges.collect()) == [1.0, 2.0, 4.0]
    assert sorted(map(tuple, nodes.collect())) == [(1, 1.0, 2.0), (2, 1.0, 0.0), (3, 1.0, 0.0)]
    given = spark.createDataFrame([(1, 5.0, 7.0), (2, None, None), (3, 2.0, None), (4, 1.0, None)], "node long, size double, self_weight double")
    assert sorted(map(tuple, graph_tables(e, given)[1].collect())) == [(1, 5.0, 7.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 1.0, 0.0)]
    for bad, text in ((given.where("node < 3"), "no node"), (given.unionByName(given), "twice")):
        with pytest.raises(ValueError, match=text):
            graph_tables(e, bad)


def test_stage_log(tmp_path):
    from wellcut.telemetry import logger

    logger(str(tmp_path / "a.log"), 1, "stage 3").info("read %s", "x")
    line = (tmp_path / "a.log").read_text()
    assert line.startswith("[INFO][0-0:0:0](t=") and line.endswith("ms) stage 3: read x\n")
