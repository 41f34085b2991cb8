import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wellcut.functions.criterion import Criterion
from wellcut.operators import mincut
from wellcut.operators.components import union_find
from wellcut.operators.mincut import adjacency, brute_force_cut, components, edge_connectivity_to_two, global_min_cut, subgraph
from wellcut.operators.refine import split_all, trim


def graph(pairs):
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return adjacency(a[:, 0], a[:, 1])


edges = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=30)


@settings(max_examples=300, deadline=None)
@given(edges)
def test_min_cut_against_brute_force(pairs):
    adj = graph(pairs)
    if len(adj) < 2:
        return
    cut, side = global_min_cut(adj)
    assert cut == brute_force_cut(adj)
    s = set(side)
    assert 0 < len(s) < len(adj)
    assert sum(w for u in s for v, w in adj[u].items() if v not in s) == cut
    for cap in range(1, 6):
        found = global_min_cut(adj, cap)
        assert (found is None) == (cut >= cap)
        assert found is None or found[0] == cut


@settings(max_examples=200, deadline=None)
@given(edges)
def test_union_find_against_search(pairs):
    a = np.array(pairs, np.int64)
    nodes, comp = union_find(a[:, 0], a[:, 1])
    full = {u: {} for p in pairs for u in p}
    for u, v in pairs:
        full[u][v] = full[v][u] = 1
    want = {u: c[0] for c in components(full) for u in c}
    assert dict(zip(nodes.tolist(), comp.tolist(), strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(edges, st.sampled_from(["1log_10(n)", "2log_10(n)", "1n^0.5", "log_2(n)"]))
def test_wcc_invariants(pairs, text):
    adj, c = graph(pairs), Criterion.parse(text)
    found = split_all(adj, c)
    flat = [u for g in found for u in g]
    assert len(flat) == len(set(flat))
    for g in found:
        sub = subgraph(adj, set(g))
        assert len(g) >= 2 and len(components(sub)) == 1
        assert c.holds(len(g), brute_force_cut(sub))
        assert split_all(sub, c) == [g]  # splitting again changes nothing
    assert sorted(split_all(adj, Criterion.parse("0n^1"))) == sorted(x for x in components(adj) if len(x) > 1)


def test_leaves_go_one_at_a_time_and_stop_when_the_rest_passes():
    # a star of 12 nodes: two leaves go, then 10 nodes pass with a cut of 1
    adj = graph([(0, i) for i in range(1, 12)])
    assert split_all(adj, Criterion.parse("1log_10(n)")) == [[0, 3, 4, 5, 6, 7, 8, 9, 10, 11]]


def test_parallel_edges_add_up_and_loops_count_nothing():
    adj = graph([(0, 1), (0, 1), (1, 1), (1, 2)])
    assert global_min_cut(adj) == (1, [2])


def test_large_ring_of_cliques():
    rng = random.Random(3)
    pairs = []
    for k in range(40):
        ids = range(k * 10, k * 10 + 10)
        pairs += [(a, b) for a in ids for b in ids if a < b]
        pairs.append((k * 10 + rng.randrange(10), ((k + 1) % 40) * 10 + rng.randrange(10)))
    cut, _ = global_min_cut(graph(pairs))
    assert cut == 2
    found = split_all(graph(pairs), Criterion.parse("2log_10(n)"))
    assert sorted(len(g) for g in found) == [10] * 40


def test_connectivity_up_to_two_against_brute_force():
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        n = rng.randrange(2, 8)
        pairs = [(i, (i + 1) % n) for i in range(n) if rng.random() < 0.7] + [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, n))]
        adj = graph([p for p in pairs if p[0] != p[1]])
        if len(adj) > 1:
            cut = brute_force_cut(adj)
            assert edge_connectivity_to_two(adj) == min(2, cut) and global_min_cut(adj)[0] == cut
            seen.add(min(2, cut))
    assert seen == {0, 1, 2}


def one_by_one(adj, c):
    """trim as it is defined: a minimum cut after another."""
    while len(adj) > 1:
        found = global_min_cut(adj, c.required_cut(len(adj)))
        if found is None or len(found[1]) > 1:
            return found and found[1]
        (u,) = found[1]
        adj_u = adj.pop(u)
        for v in adj_u:
            del adj[v][u]
            if not adj[v]:
                del adj[v]
    return None


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.sampled_from(["1log_10(n)", "2log_10(n)", "1n^0.5", "log_2(n)", "0.3n^0.9"]))
def test_nodes_come_off_as_by_one_minimum_cut_after_another(seed, block, text):
    # blocks of nodes with random edges: some cuts part one node, some whole blocks
    rng, c = random.Random(seed), Criterion.parse(text)
    pairs = [(u, v) for u in range(30) for v in range(u) if u // block == v // block and rng.random() < 0.8] + [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(60))]
    adj = graph(pairs)
    for nodes in components(adj):
        if len(nodes) > 1:
            got, want = subgraph(adj, set(nodes)), subgraph(adj, set(nodes))
            assert trim(got, c) == one_by_one(want, c) and got == want


def test_whole_graphs_are_not_searched_for_every_node_that_comes_off(monkeypatch):
    rng = random.Random(5)
    adj = graph([(rng.randrange(400), rng.randrange(400)) for _ in range(950)])
    searched = []
    for name in ("_scan", "edge_connectivity_to_two"):
        f = getattr(mincut, name)
        monkeypatch.setattr(mincut, name, lambda adj, f=f: searched.append(len(adj)) or f(adj))
    split_all(adj, Criterion.parse("2log_10(n)"))
    assert sum(searched) < 10 * 400  # 90,327 nodes where a search follows every node that comes off


def test_a_cut_of_two_does_not_pass_above_a_hundred_nodes():
    # a ring is its own 2-core, but 1log_10(n) asks 120 nodes for a cut of 3: it opens and falls to 10 nodes, where 1 passes
    assert split_all(graph([(i, (i + 1) % 120) for i in range(120)]), Criterion.parse("1log_10(n)")) == [list(range(110, 120))]
