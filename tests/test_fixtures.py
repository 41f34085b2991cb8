"""Small graphs with known results, written to files and read by the readers."""

import pytest

from wellcut.cli import main, parser
from wellcut.operators.graph import decode
from wellcut.operators.refine import cc, cm, wcc, wcc_rounds
from wellcut.sources import io

# two dense blobs and a clique in a chain; a tail of leaves
BLOBS = [(a, b) for g in ((1, 2, 3, 4, 5), (10, 11, 12, 13, 14), (21, 22, 23, 24, 25)) for i, a in enumerate(g) for b in g[i + 1 :]]
CHAIN = [*BLOBS, (5, 10), (14, 21)]


def write(tmp_path, name, rows, sep="   "):
    p = tmp_path / name
    p.write_text("\n".join(sep.join(map(str, r)) for r in rows))
    return str(p)


def partition(df, dictionary):
    out = {}
    for r in decode(df, dictionary).collect():
        out.setdefault(r["cluster_id"], set()).add(r["node"])
    return sorted(sorted(map(int, s)) for s in out.values())


@pytest.fixture
def chain(spark, tmp_path):
    nodes = sorted({u for e in CHAIN for u in e})
    return io.load(spark, write(tmp_path, "e.tsv", CHAIN), write(tmp_path, "c.tsv", [(u, 7) for u in nodes] + [(99, 7)]))


def test_queries_on_a_chain_of_blobs(chain):
    edges, clusters, d = chain
    assert partition(cc(edges, clusters), d) == [[1, 2, 3, 4, 5, 10, 11, 12, 13, 14, 21, 22, 23, 24, 25]]
    blobs = [[1, 2, 3, 4, 5], [10, 11, 12, 13, 14], [21, 22, 23, 24, 25]]
    assert partition(wcc(edges, clusters, "2log_10(n)"), d) == blobs
    rounds, telemetry = wcc_rounds(edges, clusters, "2log_10(n)")
    assert partition(rounds, d) == blobs
    assert [t["iteration"] for t in telemetry] == list(range(len(telemetry))) and telemetry[-1]["pending"] == 0
    assert partition(wcc(edges, clusters, "0"), d) == partition(cc(edges, clusters, strategy="star"), d)
    assert partition(wcc(edges, clusters, "1n^1"), d) == []
    for algorithm in ("leiden-cpm", "leiden-mod", "louvain"):
        assert partition(cm(edges, clusters, algorithm, 0.2, "2log_10(n)"), d) == blobs
        assert partition(cm(edges, None, algorithm, 0.2, "2log_10(n)"), d) == blobs


def test_ids_are_gap_free_in_the_order_of_the_smallest_node(chain):
    edges, clusters, _ = chain
    rows = wcc(edges, clusters, "2log_10(n)").collect()
    low = {}
    for r in rows:
        low[r["cluster_id"]] = min(low.get(r["cluster_id"], 1 << 60), r["node"])
    assert sorted(low) == list(range(len(low))) and [low[k] for k in sorted(low)] == sorted(low.values())


def test_clusters_bound_components(spark, tmp_path):
    edges, clusters, d = io.load(spark, write(tmp_path, "e", CHAIN, " "), write(tmp_path, "c", [(u, u // 10) for e in CHAIN for u in e], "\t"))
    assert partition(cc(edges, clusters), d) == [[1, 2, 3, 4, 5], [10, 11, 12, 13, 14], [21, 22, 23, 24, 25]]


def test_reader_rules(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_bytes(b"a,x,b\r\nb,,c\n\nc,c\nd\n")
    edges, d = io.read_edges(spark, str(p))
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [("a", "b"), ("b", "c"), ("c", "c"), ("d", "d")]
    assert [r["node"] for r in d.orderBy("id").collect()] == ["a", "b", "c", "d"]
    skipped, d2 = io.read_edges(spark, str(p), compat_first_line_skip=True)
    assert skipped.count() == 3 and d2.count() == 4
    headed, d3 = io.read_edges(spark, str(p), header=True)
    assert headed.count() == 3 and d3.count() == 3
    c = tmp_path / "c.tsv"
    c.write_text("node\tcluster\na\t1\nb\t 12abc\na\t3\nc\tx\n")
    assert {r["node"]: r["cluster_id"] for r in io.read_clustering(spark, str(c)).collect()} == {"node": 0, "a": 3, "b": 12, "c": 0}
    w = tmp_path / "w.txt"
    w.write_text("1 2 0.5\n2 3\n")
    assert sorted((r["src"], r["dst"], r["weight"]) for r in io.read_edges(spark, str(w), weighted=True)[0].collect()) == [("1", "2", 0.5), ("2", "3", 1.0)]
    i = tmp_path / "i.txt"
    i.write_text("5 9\n6   9\n5 2\n")
    assert {r["node"]: r["cluster_id"] for r in io.read_clustering_ints(spark, str(i)).collect()} == {5: 2, 6: 9}
    assert {r["node"]: r["cluster_id"] for r in io.read_clustering_reindexed(spark, str(i)).collect()} == {"5": 1, "6": 0}
    bad = tmp_path / "bad"
    bad.write_text("onefield\n")
    with pytest.raises(ValueError):
        io.sniff_delimiter(spark, str(bad))


def test_command_line(spark, tmp_path):
    e, c = write(tmp_path, "e", CHAIN), write(tmp_path, "c", [(u, 1) for x in CHAIN for u in x])
    out = str(tmp_path / "out")
    args = ["MincutOnly", "--edgelist", e, "--existing-clustering", c, "--output-file", out, "--log-header", str(tmp_path / "log"), "--connectedness-criterion", "2log_10(n)"]
    for extra in ([], ["--mode", "rounds"], ["--connectedness-criterion", "0"]):
        assert main(args + extra) == 0
        rows = spark.read.csv(out, header=True)
        assert rows.columns == ["node_id", "cluster_id"] and rows.count() == 15
        assert rows.select("cluster_id").distinct().count() == (1 if "0" in extra else 3)
        assert "[INFO][0-0:" in (tmp_path / "log_0.log").read_text()
        assert ("'op': 'split'" in (tmp_path / "log_ops.log").read_text()) == ("rounds" in extra)
    assert main(["CM", "--edgelist", e, "--algorithm", "louvain", "--output-file", out, "--log-file", str(tmp_path / "cm.log")]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["CM", "--edgelist", e, "--algorithm", "other", "--output-file", out, "--log-file", "x"])
