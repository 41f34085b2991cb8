"""Community detection inside a task: Louvain (Blondel et al. 2008) and Leiden (Traag et al. 2019).

Both quality functions have the gain  w(v, C) - r * a_v * A_C  for a move of v into C: the constant Potts model with node
sizes as a and r the resolution, modularity with strengths as a and r = 1 / 2m. Communities never span components, so a
graph is clustered component by component, in parallel.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellcut.operators.components import components_by_star
from wellcut.operators.graph import with_default_weight
from wellcut.session import dealt

ALGORITHMS = ("leiden-cpm", "leiden-mod", "louvain")
Weighted = list[dict[int, float]]


def _move(adj: Weighted, a: list[float], r: float, comm: list[int], rng: random.Random, order: list[int] | None = None) -> bool:
    """Moves nodes to the neighbouring or empty community of the greatest gain until none gains; True if any moved."""
    n = len(adj)
    total = [0.0] * n
    count = [0] * n
    for v in range(n):
        total[comm[v]] += a[v]
        count[comm[v]] += 1
    empty = dict.fromkeys(c for c in range(n - 1, -1, -1) if not count[c])  # in order; the last one is taken first
    queue = order or list(range(n))
    rng.shuffle(queue)
    waiting = set(queue)
    moved, at = False, 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting.discard(v)
        old = comm[v]
        links: dict[int, float] = {}
        for u, w in adj[v].items():
            if u != v:
                links[comm[u]] = links.get(comm[u], 0.0) + w
        total[old] -= a[v]
        count[old] -= 1
        best, gain = old, links.get(old, 0.0) - r * a[v] * total[old]
        for c in sorted(links):
            g = links[c] - r * a[v] * total[c]
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12 and count[old] and empty:
            best = next(reversed(empty))
        if best != old:
            if not count[best]:
                del empty[best]
            if not count[old]:
                empty[old] = None
            moved = True
            comm[v] = best
            for u in adj[v]:
                if comm[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
        total[best] += a[v]
        count[best] += 1
    return moved


def _refine(adj: Weighted, a: list[float], r: float, comm: list[int], rng: random.Random) -> list[int]:
    """Parts of the communities: nodes start alone and join, once, a well-connected part of their community."""
    n = len(adj)
    part = list(range(n))
    total, size = a[:], [1] * n
    whole: dict[int, float] = {}
    for v in range(n):
        whole[comm[v]] = whole.get(comm[v], 0.0) + a[v]
    inner = [sum(w for u, w in adj[v].items() if u != v and comm[u] == comm[v]) for v in range(n)]
    outer = inner[:]  # of each part, weight to the rest of its community
    order = list(range(n))
    rng.shuffle(order)
    for v in order:
        rest = whole[comm[v]] - a[v]
        if size[part[v]] > 1 or inner[v] < r * a[v] * rest - 1e-12:
            continue
        links: dict[int, float] = {}
        for u, w in adj[v].items():
            if u != v and comm[u] == comm[v]:
                links[part[u]] = links.get(part[u], 0.0) + w
        best, gain = part[v], 0.0
        for p in sorted(links):
            if p == part[v] or outer[p] < r * total[p] * (whole[comm[v]] - total[p]) - 1e-12:
                continue
            if (g := links[p] - r * a[v] * total[p]) > gain + 1e-12:
                best, gain = p, g
        if best != part[v]:
            old = part[v]
            part[v] = best
            total[best] += a[v]
            size[best] += 1
            total[old], size[old] = 0.0, 0
            outer[best] += inner[v] - 2 * links[best]
    return part


def _collapse(adj: Weighted, a: list[float], part: list[int]) -> tuple[Weighted, list[float], list[int]]:
    """The graph of the parts, and each node's place in it; loops hold the weight inside."""
    names = {p: i for i, p in enumerate(dict.fromkeys(part))}
    at = [names[p] for p in part]
    out: Weighted = [{} for _ in names]
    size = [0.0] * len(names)
    for v, n in enumerate(adj):
        size[at[v]] += a[v]
        row = out[at[v]]
        for u, w in n.items():
            row[at[u]] = row.get(at[u], 0.0) + w
    return out, size, at


def _dense(comm: list[int]) -> list[int]:
    names = {c: i for i, c in enumerate(dict.fromkeys(comm))}
    return [names[c] for c in comm]


def leiden(adj: Weighted, a: list[float], r: float, seed: int = 0, iterations: int = 2, start: list[int] | None = None) -> list[int]:
    rng = random.Random(seed)
    final = start or list(range(len(adj)))
    for _ in range(iterations):
        graph, size, comm = adj, a, _dense(final)
        home = list(range(len(adj)))  # node of the first graph -> node of this one
        while True:
            _move(graph, size, r, comm, rng)
            final = [comm[home[v]] for v in range(len(adj))]
            if len(set(comm)) == len(graph):
                break
            part = _refine(graph, size, r, comm, rng)
            if len(set(part)) == len(graph):
                part = comm
            graph2, size2, at = _collapse(graph, size, part)
            up = [0] * len(graph2)
            for v, p in enumerate(at):
                up[p] = comm[v]
            if len(graph2) == len(graph):
                break
            graph, size, comm, home = graph2, size2, _dense(up), [at[h] for h in home]
    return final


def louvain(adj: Weighted, a: list[float], r: float, seed: int = 0) -> list[int]:
    rng = random.Random(seed)
    graph, size, home = adj, a, list(range(len(adj)))
    while True:
        comm = list(range(len(graph)))
        if not _move(graph, size, r, comm, rng):
            return home
        graph, size, at = _collapse(graph, size, comm)
        home = [at[h] for h in home]


def cluster(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, algorithm: str, resolution: float = 0.01, seed: int = 0, iterations: int = 2, total: float | None = None) -> dict[int, int]:
    """Node to community of the nodes of some edges; a community is named by its smallest node. ``total`` is the graph's weight for modularity."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} isn't one of {', '.join(ALGORITHMS)}")
    nodes, idx = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = idx[: len(src)].tolist(), idx[len(src) :].tolist()
    weight = np.ones(len(src)) if algorithm == "louvain" else weight
    adj: Weighted = [{} for _ in nodes]
    strength = [0.0] * len(nodes)
    for u, v, w in zip(a, b, weight.tolist(), strict=True):
        strength[u] += w
        strength[v] += w
        if u != v:
            adj[u][v] = adj[u].get(v, 0.0) + w
            adj[v][u] = adj[v].get(u, 0.0) + w
    if algorithm == "leiden-cpm":
        found = leiden(adj, [1.0] * len(nodes), resolution, seed, iterations)
    else:
        m = total or float(weight.sum()) or 1.0
        found = leiden(adj, strength, 1 / (2 * m), seed, iterations) if algorithm == "leiden-mod" else louvain(adj, strength, 1 / (2 * m), seed)
    low: dict[int, int] = {}
    for u, c in zip(nodes.tolist(), found, strict=True):
        low.setdefault(c, u)
    return {u: low[c] for u, c in zip(nodes.tolist(), found, strict=True)}


def cluster_graph(edges: DataFrame, algorithm: str, resolution: float = 0.01, seed: int = 0, iterations: int = 2) -> DataFrame:
    """edges(src, dst[, weight]): (node, cluster_id) of every node of an edge, one task for each component."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} isn't one of {', '.join(ALGORITHMS)}")
    e = with_default_weight(edges)
    unit = algorithm == "louvain"
    total = None if algorithm == "leiden-cpm" else e.agg(F.count("*") if unit else F.sum("weight")).first()[0]
    comp = components_by_star(e)
    rows = e.join(comp.select(F.col("node").alias("src"), "component"), "src")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        found = cluster(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), algorithm, resolution, seed, iterations, total and float(total))
        return pd.DataFrame({"node": list(found), "cluster_id": list(found.values())})

    return dealt(rows, "component").groupBy("component").applyInPandas(solve, "node long, cluster_id long")
