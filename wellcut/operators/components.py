"""Connected components.

Two strategies over the same contract, ``(node, component)`` with component = the smallest node reachable:

* ``task``: the clusters bound the problem, so each cluster's edges go to one grouped-map task with a union-find.
* ``star``: alternating large-star and small-star rounds as DataFrame joins (Kiveris et al. 2014), for graphs or
  clusters of any size. Each round is written to the shared folder, so lineage stays short and lost executors cost
  one round at most. Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellcut.session import Stored


def union_find(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of the component of each, both int64, nodes ascending."""
    nodes, idx = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = idx[: len(src)], idx[len(src) :]
    parent = np.arange(len(nodes))
    while True:
        # hook the larger root of each edge to the smaller one, then halve paths; vectorised over all edges
        pa, pb = parent[a], parent[b]
        low, high = np.minimum(pa, pb), np.maximum(pa, pb)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return nodes, nodes[parent]


def components_by_task(edges: DataFrame, key: str = "cluster_id") -> DataFrame:
    """edges(key, src, dst): components within each key, as (key, node, component)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comp = union_find(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "node": nodes, "component": comp})

    kind = edges.schema[key].dataType.simpleString()
    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(solve, f"{key} {kind}, node long, component long")


def components_by_star(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src long, dst long): (node, component) for every node of an edge. Loops only keep their node alive."""
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = Stored(e, "star")
    nodes = now.df.where("u = v").select(F.col("u").alias("node"))
    state: tuple | None = None
    kept: list[Stored] = [now]
    for _ in range(max_rounds):
        e = now.df.where("u <> v")
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that has only larger neighbours keeps no edge of its own: its neighbours point at it already
        large = large.where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select("v", "u", "m")
        out = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lows.select("u", F.col("m").alias("v"))
        )
        nxt = Stored(out.distinct(), "star")
        row = nxt.df.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if len(kept) > 1:
            kept.pop().drop()
        kept.append(nxt)
        now = nxt
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = label.unionByName(roots)
    alone = nodes.join(found, "node", "left_anti").select("node", F.col("node").alias("component")).distinct()
    return found.unionByName(alone)
