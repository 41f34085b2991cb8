"""Global minimum cuts of small graphs inside a task, and the operator that applies them to components.

The solver contracts after maximum-adjacency scans (Nagamochi, Ono and Ibaraki 1994): a scan gives each edge a lower
bound of the connectivity of its ends, and edges whose bound reaches the best cut so far can't be crossed by a better
one. With a cap, graphs whose minimum cut reaches the cap contract to a point without the cut's being known, which is
all that a threshold test needs. Ties go to the smallest node throughout, so results are the same at every run.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wellcut.session import dealt

Adjacency = dict[int, dict[int, int]]


def adjacency(src: np.ndarray, dst: np.ndarray) -> Adjacency:
    """Neighbours with the number of parallel edges; loops go."""
    out: Adjacency = {}
    for u, v in zip(src.tolist(), dst.tolist(), strict=True):
        if u != v:
            a, b = out.setdefault(u, {}), out.setdefault(v, {})
            a[v] = a.get(v, 0) + 1
            b[u] = b.get(u, 0) + 1
    return out


def components(adj: Adjacency, nodes: set[int] | None = None) -> list[list[int]]:
    """Components of the subgraph of some nodes, each ascending, by their smallest node."""
    left = set(adj) if nodes is None else set(nodes)
    out = []
    for start in sorted(left):
        if start not in left:
            continue
        left.discard(start)
        stack, found = [start], [start]
        while stack:
            for v in adj[stack.pop()]:
                if v in left:
                    left.discard(v)
                    stack.append(v)
                    found.append(v)
        out.append(sorted(found))
    return out


def subgraph(adj: Adjacency, nodes: set[int]) -> Adjacency:
    return {u: {v: w for v, w in adj[u].items() if v in nodes} for u in nodes}


def _scan(adj: Adjacency) -> tuple[list[int], dict[tuple[int, int], int], list[int]]:
    """Maximum-adjacency order from the smallest node, bounds of the edges, and the cut after each prefix."""
    start = min(adj)
    reach, done = dict.fromkeys(adj, 0), set()
    heap = [(0, start)]
    order, bound, cuts, cut = [], {}, [], 0
    waiting = set(adj)
    while waiting:
        while heap:
            r, u = heapq.heappop(heap)
            if u in waiting and -r == reach[u]:
                break
        else:  # not connected: the prefix is a cut of 0
            u = min(waiting)
        waiting.discard(u)
        done.add(u)
        order.append(u)
        cut += sum(adj[u].values()) - 2 * reach[u]
        cuts.append(cut)
        for v, w in adj[u].items():
            if v in waiting:
                reach[v] += w
                bound[u, v] = reach[v]
                heapq.heappush(heap, (-reach[v], v))
    return order, bound, cuts


def edge_connectivity_to_two(adj: Adjacency) -> int:
    """0 for a graph in parts, 1 for one with a bridge, else 2: the smaller of 2 and the minimum cut, by one depth-first search."""
    root = next(iter(adj))
    entered, low = {root: 0}, {root: 0}
    stack = [(root, root, iter(adj[root].items()))]
    bridge = False
    while stack:
        u, parent, rest = stack[-1]
        for v, w in rest:
            if v not in entered:
                entered[v] = low[v] = len(entered)
                stack.append((v, u, iter(adj[v].items())))
                break
            if (v != parent or w > 1) and entered[v] < low[u]:
                low[u] = entered[v]
        else:
            stack.pop()
            if stack:
                low[parent] = min(low[parent], low[u])
                bridge |= low[u] > entered[parent]
    return 0 if len(entered) < len(adj) else 1 if bridge else 2


def global_min_cut(adj: Adjacency, cap: float | None = None) -> tuple[int, list[int]] | None:
    """The minimum cut's size and the side that holds fewer nodes (the smallest node in a tie); None if it isn't below the cap."""
    if len(adj) < 2:
        return None
    every = sorted(adj)
    best: float = float("inf") if cap is None else cap
    side: list[int] | None = None
    least, u = min((sum(adj[u].values()), u) for u in every)
    if least < best and least <= 2 and edge_connectivity_to_two(adj) >= least:
        return least, [u]  # no cut is smaller than that around the smallest of the nodes with the fewest edges
    group = {u: [u] for u in every}
    now = adj
    while len(now) > 1:
        for u in sorted(now):
            if (d := sum(now[u].values())) < best:
                best, side = d, group[u]
        if best == 0:
            break
        order, bound, cuts = _scan(now)
        for i, c in enumerate(cuts[:-1]):
            if c < best:
                best, side = c, [x for u in order[: i + 1] for x in group[u]]
        parent = {u: u for u in now}

        def find(u: int, parent: dict[int, int] = parent) -> int:
            while parent[u] != u:
                parent[u] = parent[parent[u]]
                u = parent[u]
            return u

        for (u, v), q in bound.items():
            if q >= best and (a := find(u)) != (b := find(v)):
                parent[max(a, b)] = min(a, b)
        merged: Adjacency = {}
        members: dict[int, list[int]] = {}
        for u in now:
            a = find(u)
            members.setdefault(a, []).extend(group[u])
            row = merged.setdefault(a, {})
            for v, w in now[u].items():
                if (b := find(v)) != a:
                    row[b] = row.get(b, 0) + w
        if len(merged) == len(now):  # can't be: the last two nodes of a scan always merge
            raise AssertionError("no contraction")
        now, group = merged, members
    if side is None:
        return None
    inside = set(side)
    other = [u for u in every if u not in inside]
    small = min((sorted(inside), other), key=lambda x: (len(x), x))
    return int(best), small


def cut_reaches(adj: Adjacency, bound: float) -> bool:
    """Whether the minimum cut of a graph of two nodes at least reaches a bound."""
    return edge_connectivity_to_two(adj) >= bound if bound <= 2 else global_min_cut(adj, bound) is None


def brute_force_cut(adj: Adjacency) -> int:
    """The minimum cut by trying every side; for tests."""
    nodes = sorted(adj)
    best = None
    for mask in range(1, 1 << (len(nodes) - 1)):
        side = {u for i, u in enumerate(nodes) if mask >> i & 1}
        cut = sum(w for u in side for v, w in adj[u].items() if v not in side)
        best = cut if best is None else min(best, cut)
    return best or 0


def min_cuts(edges: DataFrame, key: str = "component") -> DataFrame:
    """edges(key, src, dst), a connected graph for each key: (key, n_nodes, cut_size, side_a, side_b), sides' sizes."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        found = global_min_cut(adj)
        cut, side = found or (0, [])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n_nodes": [len(adj)], "cut_size": [cut], "side_a": [len(side)], "side_b": [len(adj) - len(side)]})

    return dealt(edges.select(key, "src", "dst"), key).groupBy(key).applyInPandas(solve, f"{key} {kind}, n_nodes long, cut_size long, side_a long, side_b long")


def min_cut_sides(edges: DataFrame, key: str = "component") -> DataFrame:
    """(key, node, side): side 0 is the smaller one."""
    kind = edges.schema[key].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        small = set((global_min_cut(adj) or (0, []))[1])
        nodes = sorted(adj)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(nodes), "node": nodes, "side": [0 if u in small else 1 for u in nodes]})

    return dealt(edges.select(key, "src", "dst"), key).groupBy(key).applyInPandas(solve, f"{key} {kind}, node long, side int")
