"""The three queries: connected clusters (cc), well-connected clusters (wcc), and refinement with re-clustering (cm).

Input is an edge list (src, dst[, weight]) and a clustering (node, cluster_id); output is (node, cluster_id), gap-free
ids in the order of each cluster's smallest node, or with ``canonical=True`` the smallest node itself.

Only edges inside clusters are shuffled. Relational steps are DataFrame plans; the recursive splitting runs inside
grouped-map tasks, one for each cluster or component, or in rounds (``mode="rounds"``) that split every pending cluster once and
spread the parts again, so that a giant cluster becomes many tasks after its first split.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellcut.functions.criterion import SIMPLE, Criterion
from wellcut.operators.community import cluster, cluster_graph
from wellcut.operators.components import components_by_star, components_by_task
from wellcut.operators.graph import dense_numbers, intra_cluster_edges, with_default_weight
from wellcut.operators.mincut import Adjacency, adjacency, components, cut_reaches, global_min_cut, subgraph
from wellcut.session import Stored, dealt

#: Edges of a cluster up to which one task finds its components.
TASK_EDGES = 5_000_000


def _strategy(inside: DataFrame, strategy: str) -> str:
    """``task`` where every cluster fits a task, else ``star``; a given strategy stays."""
    if strategy != "auto":
        return strategy
    most = inside.groupBy("cluster_id").count().agg(F.max("count")).first()[0] or 0
    return "task" if most <= TASK_EDGES else "star"


def _inside(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges inside clusters, written down: several plans read them."""
    return Stored(intra_cluster_edges(edges, clusters), "inside").df


def _components(inside: DataFrame, strategy: str) -> DataFrame:
    found = components_by_task(inside).select("node", "component") if _strategy(inside, strategy) == "task" else components_by_star(inside)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return found.join(sizes, "component")


def connected_components(edges: DataFrame, within: DataFrame | None = None, min_size: int = 2, strategy: str = "auto") -> DataFrame:
    """(node, component) of components with ``min_size`` nodes at least, inside clusters where ``within`` is given."""
    if within is None:
        found = components_by_star(edges)
        found = found.join(found.groupBy("component").agg(F.count("*").alias("n")), "component")
    else:
        found = _components(_inside(edges, within) if strategy == "auto" else intra_cluster_edges(edges, within), strategy)
    return found.where(F.col("n") >= min_size).select("node", "component")


def _named(groups: DataFrame, canonical: bool) -> DataFrame:
    """(node, group), a group being named by its smallest node, to (node, cluster_id).

    Numbering reads the groups twice: they are written down rather than found twice.
    """
    if canonical:
        return groups.select("node", F.col("group").alias("cluster_id"))
    kept = Stored(groups.select("node", "group"), "groups").df
    ids = dense_numbers(kept.select("group").distinct(), ["group"], "cluster_id")
    return kept.join(ids, "group").select("node", "cluster_id")


def cc(edges: DataFrame, clusters: DataFrame, canonical: bool = False, strategy: str = "auto") -> DataFrame:
    """The components (of two nodes at least) of each cluster become the clusters."""
    return _named(connected_components(edges, clusters, strategy=strategy).withColumnRenamed("component", "group"), canonical)


def falling(adj: Adjacency, criterion: Criterion) -> tuple[list[list[int]], list[float]]:
    """The order in which nodes go while every minimum cut that doesn't pass has the smallest node of the fewest edges alone on a side.

    A step lists that node and a last neighbour that it leaves alone. Beside it stands the cut that the graph before the step
    must have for the order to be right: the node's edges, or where the nodes left seem to pass, what they need, without a step.
    """
    degree = {u: sum(row.values()) for u, row in adj.items()}
    heap = [(d, u) for u, d in degree.items()]
    heapq.heapify(heap)
    steps, bounds, went, n = [], [], set(), len(adj)
    while n > 1:
        d, u = heapq.heappop(heap)
        if u in went or d != degree[u]:
            continue
        need = criterion.required_cut(n)
        if d >= need:
            return steps, [*bounds, need]
        went.add(u)
        step = [u]
        for v, w in adj[u].items():
            if v not in went:
                degree[v] -= w
                if degree[v]:
                    heapq.heappush(heap, (degree[v], v))
                else:
                    went.add(v)
                    step.append(v)
        steps.append(step)
        bounds.append(d)
        n -= len(step)
    return steps, bounds


def verified(adj: Adjacency, steps: list[list[int]], bounds: list[float], end: int) -> tuple[int, int | None]:
    """How many graphs, from the first, have the cuts that ``falling`` takes for granted, and the first one seen with a smaller one.

    Goes backwards from the graph ``end``. Where a later graph's cut is known to reach a bound, that graph counts as one node for the graphs before it
    with bounds as small, so what is searched is the nodes that went in between; a whole graph is searched only where all later
    bounds are smaller. Where graphs fail, ever more of them are passed over: they aren't counted, and are searched later.
    """
    last = len(steps)
    at = {u: i for i, step in enumerate(steps) for u in step}
    known: list[int] = []  # graphs whose bounds hold, the first on top, bounds falling to it
    i = top = end
    failed, misses = None, 0
    while i >= 0:
        bound = bounds[i]
        while known and bounds[known[-1]] < bound:
            known.pop()
        if not known:
            rest = {u for u in adj if at.get(u, last) >= i}
            holds = cut_reaches(subgraph(adj, rest), bound)
        elif known[-1] == i + 1 and len(steps[i]) == 1:
            holds = True  # a node joins with as many edges
        else:
            holds = cut_reaches(_shrunk(adj, [u for step in steps[i : known[-1]] for u in step], at, i, known[-1], last), bound)
        if holds:
            while known and bounds[known[-1]] <= bound:
                known.pop()
            known.append(i)
            i -= 1
        elif i:
            failed, i = i, max(i - (1 << misses), 0)
            top, misses = i, misses + 1
        else:
            return 0, 0
    return top + 1, failed


def _shrunk(adj: Adjacency, nodes: list[int], at: dict[int, int], first: int, end: int, last: int) -> Adjacency:
    """The graph of the nodes that go in the steps first to end, those that stay longer being one node."""
    rest = min(nodes) - 1
    out: Adjacency = {rest: {}}
    for u in nodes:
        row: dict[int, int] = {}
        for v, w in adj[u].items():
            step = at.get(v, last)
            if step >= end:
                row[rest] = row.get(rest, 0) + w
            elif step >= first:
                row[v] = w
        if rest in row:
            out[rest][u] = row[rest]
        out[u] = row
    return out


def trim(adj: Adjacency, criterion: Criterion) -> list[int] | None:
    """Takes nodes off a connected graph, in place, while its minimum cut has one alone on a side and doesn't pass.

    Returns the smaller side of the first cut that parts more than a node; None where what is left passes, or nothing is left.
    """
    steps, bounds = falling(adj, criterion)
    end, weak = len(bounds) - 1, len(bounds)
    while bounds:
        right, failed = verified(adj, steps, bounds, end)
        weak = weak if failed is None else failed
        for u in (u for step in steps[:right] for u in step):
            for v in adj.pop(u):
                if v in adj:
                    del adj[v][u]
        if right == len(bounds):
            break
        if right == weak:
            found = global_min_cut(adj, criterion.required_cut(len(adj)))
            return found and found[1]
        # the first weak graph is one of those up to the one seen: half of them come next
        steps, bounds, weak = steps[right:], bounds[right:], weak - right
        end = weak // 2
    return None


def split_once(adj: Adjacency, criterion: Criterion) -> tuple[bool, list[Adjacency]]:
    """One generation: (True, [cluster]) if, trimmed, it is well connected, else the parts with two nodes at least. Changes adj."""
    side = trim(adj, criterion)
    if side is None:
        return bool(adj), [adj] if adj else []
    a = set(side)
    parts = [c for nodes in (a, set(adj) - a) for c in components(adj, nodes) if len(c) > 1]
    return False, [subgraph(adj, set(c)) for c in parts]


def split_all(adj: Adjacency, criterion: Criterion) -> list[list[int]]:
    """The well-connected clusters of a graph, by an explicit stack."""
    stack, done = [subgraph(adj, set(c)) for c in components(adj) if len(c) > 1], []
    while stack:
        passed, parts = split_once(stack.pop(), criterion)
        if passed:
            done.append(sorted(parts[0]))
        else:
            stack += parts
    return done


def _rows(groups: list[list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"node": np.array([u for g in groups for u in g], np.int64), "group": np.array([g[0] for g in groups for _ in g], np.int64)})


def _by_component(edges: DataFrame, clusters: DataFrame, strategy: str) -> DataFrame:
    """Edges inside clusters with their component: (component, src, dst[, weight])."""
    inside = _inside(edges, clusters)
    comp = _components(inside, strategy).select(F.col("node").alias("src"), "component")
    return inside.where("src <> dst").drop("cluster_id").join(comp, "src")


def _by_task(edges: DataFrame, clusters: DataFrame, strategy: str) -> DataFrame:
    """Edges inside clusters with a key that tasks are dealt by: the cluster where it fits a task, else the component.

    What runs on a key finds the components itself, so clusters that fit need one shuffle only.
    """
    inside = _inside(edges, clusters)
    if _strategy(inside, strategy) == "task":
        return inside.where("src <> dst").withColumnRenamed("cluster_id", "key")
    comp = components_by_star(inside).select(F.col("node").alias("src"), F.col("component").alias("key"))
    return inside.where("src <> dst").drop("cluster_id").join(comp, "src")


def wcc(edges: DataFrame, clusters: DataFrame, criterion: str = "1log_10(n)", mode: str = "task", canonical: bool = False, strategy: str = "auto") -> DataFrame:
    """Components of the clusters, split along minimum cuts until every cluster's minimum cut exceeds f(n)."""
    c = Criterion.parse(criterion)
    if c.kind == SIMPLE:
        return cc(edges, clusters, canonical, strategy)
    if mode == "rounds":
        return wcc_rounds(edges, clusters, criterion, canonical, strategy)[0]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(split_all(adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy()), c))

    found = dealt(_by_task(edges, clusters, strategy).select("key", "src", "dst"), "key").groupBy("key").applyInPandas(solve, "node long, group long")
    return _named(found, canonical)


def wcc_rounds(edges: DataFrame, clusters: DataFrame, criterion: str = "1log_10(n)", canonical: bool = False, strategy: str = "auto", max_rounds: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """wcc in generations, each a job whose result is written down, with a telemetry row for each."""
    c = Criterion.parse(criterion)
    pending = Stored(_by_component(edges, clusters, strategy).select(F.col("component").alias("group"), "src", "dst"), "pending")
    spark = edges.sparkSession
    telemetry: list[dict] = []

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        passed, parts = split_once(adjacency(pdf["src"].to_numpy(), pdf["dst"].to_numpy()), c)
        rows = []
        for p in parts:
            low = min(p)
            if passed:
                rows += [(True, low, u, u) for u in p]
            else:
                rows += [(False, low, u, v) for u, n in p.items() for v, w in n.items() if u < v for _ in range(w)]
        return pd.DataFrame(rows, columns=["done", "group", "src", "dst"]).astype({"done": bool, "group": np.int64, "src": np.int64, "dst": np.int64})

    kept: list[Stored] = []
    for i in range(max_rounds):
        began = time.perf_counter()
        out = Stored(dealt(pending.df, "group").groupBy("group").applyInPandas(step, "done boolean, group long, src long, dst long"), "round")
        row = out.df.agg(
            F.count_distinct(F.when(F.col("done"), F.col("group"))).alias("finished"), F.count_distinct(F.when(~F.col("done"), F.col("group"))).alias("left")
        ).first()
        telemetry.append({"stage": "wcc", "iteration": i, "op": "split", "wall_s": time.perf_counter() - began, "bytes": out.size(), "finished": row["finished"], "pending": row["left"]})
        pending.drop()
        if row["finished"]:
            kept.append(Stored(out.df.where("done").select(F.col("src").alias("node"), "group"), "done"))
        if row["left"]:
            pending = Stored(out.df.where("NOT done").select("group", "src", "dst"), "pending")
        out.drop()
        if not row["left"]:
            break
    else:
        raise RuntimeError(f"clusters were left after {max_rounds} rounds")
    done = reduce(DataFrame.unionByName, [x.df for x in kept]) if kept else spark.createDataFrame([], "node long, group long")
    return _named(done, canonical), telemetry


def cm_cluster(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, criterion: Criterion, algorithm: str, resolution: float, seed: int, total: float | None) -> list[list[int]]:
    """The refined clusters of a graph: trivial cuts are peeled in place, the sides of others are clustered anew."""
    adj = adjacency(src, dst)
    weights: dict[tuple[int, int], float] = {}
    for u, v, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if u != v:
            k = (min(u, v), max(u, v))
            weights[k] = weights.get(k, 0.0) + w
    queue, done = deque(subgraph(adj, set(c)) for c in components(adj) if len(c) > 1), []
    while queue:
        now = queue.popleft()
        side = trim(now, criterion)
        if side is None:
            if now:
                done.append(sorted(now))
            continue
        for part in (set(side), set(now) - set(side)):
            sub = subgraph(now, part)
            pairs = [(a, b) for a in sorted(sub) for b in sorted(sub[a]) if a < b for _ in range(sub[a][b])]
            if not pairs:
                continue
            x, y = np.array(pairs, np.int64).T
            w = np.array([weights[p] / sub[p[0]][p[1]] for p in pairs])
            comm = cluster(x, y, w, algorithm, resolution, seed, 2)
            inner = {a: {b: n for b, n in row.items() if comm[a] == comm[b]} for a, row in sub.items()}
            queue.extend(subgraph(inner, set(c)) for c in components(inner) if len(c) > 1)
    return done


def cm(edges: DataFrame, clusters: DataFrame | None = None, algorithm: str = "leiden-cpm", resolution: float = 0.01, criterion: str = "1log_10(n)", seed: int = 0, canonical: bool = False) -> DataFrame:
    """Refines a clustering, or the one that ``algorithm`` finds: peel, split along minimum cuts, cluster the sides anew."""
    c = Criterion.parse(criterion)
    if c.kind == SIMPLE:
        raise ValueError("cm needs a criterion with a bound")
    e = with_default_weight(edges)
    if clusters is None:
        clusters = Stored(cluster_graph(e, algorithm, resolution, seed), "initial").df
    rows = _by_task(e, clusters, "auto")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst", "weight"])
        return _rows(cm_cluster(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["weight"].to_numpy(), c, algorithm, resolution, seed, None))

    return _named(dealt(rows.select("key", "src", "dst", "weight"), "key").groupBy("key").applyInPandas(solve, "node long, group long"), canonical)
