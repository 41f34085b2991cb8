r"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Each of ``TREES`` trees splits the unit vectors at every level by their projection on a random direction. A vector whose
projection lies within ``SPILL`` of the threshold goes to both sides, so a pair is parted only where both sit beyond the
overlap. The thresholds of the upper levels are medians of a bounded sample (``max_sample`` vectors); deeper levels, which
a sample can't resolve, split at the direction's median over the sample. The depth follows the number of vectors, so that
leaves stay about ``LEAF`` vectors large at every size. Every vector is indexed in every tree.

Vectors are equal in length within a forest: each length that occurs has a forest of its own, and leaves of its own.

The trees are gone through one after the other, so that only one tree's copies of the vectors are on disk at a time, at the
width that the table has them in. All pairs of a leaf are compared, in single precision with a margin first and then in
double precision, in blocks; a leaf larger than ``BLOCK`` is spread over tasks by pairs of its parts, so a hot leaf neither
meets in one task nor loses a pair. A pair that meets in several leaves counts in the first of them only, which a task can
tell from the forest: no pair is ever sent anywhere. What comes out of a leaf is a count for each vector and links of a
spanning forest, both in proportion to its rows.

Equal vectors collapse to one with a multiplicity first. Links at cosine >= ``least`` only, confirmed exactly; pairs that
no tree brings together are missed: the tests measure recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; an id that repeats with the same vector is one vector; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import prepare
from wellcut.llm.labels import sampled
from wellcut.operators.components import components_by_star, union_find
from wellcut.session import Stored

TREES = 6
LEAF = 192
SPILL = 0.02
BLOCK = 2048
#: More than single precision can be wrong by.
MARGIN = 1e-4


@dataclass
class Forest:
    """directions[tree, level], thresholds[tree][level] by node where the sample resolves it, medians[tree, level] below."""

    directions: np.ndarray
    thresholds: list[list[np.ndarray]]
    medians: np.ndarray
    spill: float

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves of unit vectors in a tree; a row comes up once for each leaf that it falls in."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.directions.shape[1]):
            p = x[row] @ self.directions[tree, level]
            t = self.thresholds[tree][level][node] if level < len(self.thresholds[tree]) else self.medians[tree, level]
            left, right = p <= t + self.spill, p >= t - self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def grow(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 23) -> Forest:
    """Fits a forest for n vectors on a sample of unit vectors."""
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(trees, depth, sample.shape[1]))
    d /= np.linalg.norm(d, axis=2, keepdims=True)
    resolved = max(0, min(depth, math.floor(math.log2(max(1, len(sample)) / 32))))
    medians = np.zeros((trees, depth))
    thresholds: list[list[np.ndarray]] = []
    for t in range(trees):
        node, rows = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ d[t, level] if len(sample) else np.zeros(0)
            medians[t, level] = np.median(p) if len(p) else 0.0
            if level < resolved:
                cut = np.full(1 << level, medians[t, level])
                order = np.argsort(node, kind="stable")
                ids, at = np.unique(node[order], return_index=True)
                for k, part in zip(ids, np.split(p[order], at[1:]), strict=True):
                    cut[k] = np.median(part)
                rows.append(cut)
                node = 2 * node + (p > cut[node])
        thresholds.append(rows)
    return Forest(d, thresholds, medians, spill)


Forests = dict[int, Forest]


def _units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(batch: pa.RecordBatch, width: str) -> Iterator[np.ndarray | None]:
    """Vectors at the table's width; None where one links with nothing."""
    col = batch.column("embedding")
    values, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()  # a null component is a NaN here
    for i, known in enumerate(col.is_valid().to_pylist()):
        x = values[at[i] : at[i + 1]].astype(width) if known else values[:0]
        yield x if len(x) and np.isfinite(x).all() and x.any() else None


def _narrow(vectors: DataFrame) -> str:
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _raw(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the vector as bytes, null where it links with nothing), h1 and h2 (the fingerprint of its direction), dim."""
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("v", T.BinaryType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("dim", T.IntegerType())])
    width = _narrow(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = list(_vectors(b, width))
            h = [(None, None) if x is None else np.frombuffer(hashlib.blake2b((_units(x[None])[0] + 0.0).tobytes(), digest_size=16).digest(), np.int64).tolist() for x in some]
            cols = [b.column("vec_id"), pa.array([None if x is None else x.tobytes() for x in some], pa.binary()), *(pa.array([x[i] for x in h], pa.int64()) for i in (0, 1)), pa.array([0 if x is None else len(x) for x in some], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def _indexed(reps: DataFrame, forests: Broadcast, width: str, trees: list[int], fat: bool) -> DataFrame:
    """reps(rep, v, n, dim) once for each leaf of these trees that a vector falls in: (dim, tree, leaf[, rep, v, n])."""
    extra = ["rep", "v", "n"] if fat else []
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("tree", T.IntegerType()), T.StructField("leaf", T.LongType()), *[reps.schema[c] for c in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                f = forests.value[int(dim)]
                x = _units(np.frombuffer(b"".join(own.column("v").to_pylist()), width).reshape(-1, dim))
                for t in trees:
                    rows, leaves = f.leaves(x, t)
                    part = own.take(pa.array(rows))
                    cols = [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(leaves), *[part.column(c) for c in extra]]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return reps.select("rep", "v", "n", "dim").mapInArrow(run, schema)


def _earlier(a: list[np.ndarray], b: list[np.ndarray], own: int) -> np.ndarray:
    """Whether each row of a shares with each row of b, both given as lists of their leaves, a leaf before ``own`` in the order (tree, leaf)."""
    order = lambda v: (v & 0xFF) << 48 | v >> 8
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), order(np.concatenate(rows)))
    (ra, la), (rb, lb) = flat(a), flat(b)
    both = np.intersect1d(la, lb)
    both = both[both < order(np.int64(own))]
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(both), 1024):
        part = both[i : i + 1024]
        ma, mb = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for m, r, v in ((ma, ra, la), (mb, rb, lb)):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            m[r[hit], at[hit]] = 1
        out += ma @ mb.T
    return out > 0


def _close(xa: np.ndarray, xb: np.ndarray, fa: np.ndarray, fb: np.ndarray, least: float, only: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a cosine of at least ``least`` in double precision, among those in ``only``; fa and fb are in single precision."""
    x, y = np.nonzero((fa @ fb.T >= least - MARGIN) & only)
    if len(x) * 16 > len(xa) * len(xb):
        exact = (xa @ xb.T)[x, y]
    else:
        exact = np.concatenate([np.einsum("ij,ij->i", xa[x[k : k + 65536]], xb[y[k : k + 65536]]) for k in range(0, len(x), 65536)] or [np.zeros(0)])
    return x[exact >= least], y[exact >= least]


def _compare(rows: DataFrame, forests: Broadcast, width: str, tree: int, least: float) -> DataFrame:
    """Rows of a tree with parts p, lo, hi: (rep, links, other): counts by vector, and links of a spanning forest."""
    kind = rows.schema["rep"].dataType.simpleString()
    none = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["p"] == pdf["lo"]], pdf[pdf["p"] == pdf["hi"]]
        if left.empty or right.empty or len(pdf) < 2:
            return none
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        dim = int(pdf["dim"].iloc[0])
        own, forest = int(pdf["leaf"].iloc[0]) << 8 | tree, forests.value[dim]
        matrix = lambda x: _units(np.frombuffer(b"".join(x["v"]), width).reshape(-1, dim))

        def homes(x: np.ndarray) -> list[np.ndarray]:
            """The leaves of each row, in this tree and those before."""
            found = [forest.leaves(x, t) for t in range(tree + 1)]
            row, code = np.concatenate([r for r, _ in found]), np.concatenate([k << 8 | t for t, (_, k) in enumerate(found)])
            order = np.argsort(row, kind="stable")
            return np.split(code[order], np.searchsorted(row[order], np.arange(1, len(x))))

        xa, xb, ra, rb, na, nb = matrix(left), matrix(right), left["rep"].to_numpy(), right["rep"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
        fa, fb = xa.astype(np.float32), xb.astype(np.float32)
        count_a, count_b = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
        src, dst = [], []
        step = max(1, (1 << 20) // len(rb))
        for i in range(0, len(ra), step):
            x, y = _close(xa[i : i + step], xb, fa[i : i + step], fb, least, ra[i : i + step, None] < rb[None, :] if same else True)
            if not len(x):
                continue
            ua, at_a = np.unique(x + i, return_inverse=True)
            ub, at_b = np.unique(y, return_inverse=True)
            first = ~_earlier(homes(xa[ua]), homes(xb[ub]), own)[at_a, at_b]
            x, y = x[first] + i, y[first]
            count_a += np.bincount(x, weights=nb[y], minlength=len(ra)).astype(np.int64)
            count_b += np.bincount(y, weights=na[x], minlength=len(rb)).astype(np.int64)
            if len(x):
                nodes, comp = union_find(ra[x], rb[y])
                src.append(nodes)
                dst.append(comp)
        rep, links = np.concatenate([ra, rb]), np.concatenate([count_a, count_b])
        rep, links = rep[links > 0], links[links > 0]
        other = rep
        if src:
            nodes, comp = union_find(np.concatenate(src), np.concatenate(dst))
            nodes, comp = nodes[nodes != comp], comp[nodes != comp]
            rep, links, other = np.concatenate([rep, nodes]), np.concatenate([links, np.zeros(len(nodes), np.int64)]), np.concatenate([other, comp])
        return pd.DataFrame({"rep": rep, "links": links, "other": other})

    return rows.groupBy("leaf", "dim", "lo", "hi").applyInPandas(leaf, f"rep {kind}, links long, other {kind}")


def _forests(reps: DataFrame, width: str, max_sample: int, trees: int) -> Forests:
    """A forest for each length of vectors (a row for each length reaches the driver), fitted on a sample of all."""
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    ids = sampled(reps.select(F.col("rep").alias("doc_id")), max_sample).select(F.col("doc_id").alias("rep"))
    sample = reps.join(F.broadcast(ids), "rep").select("rep", "v", "dim").collect()  # at most max_sample ids
    fit: dict[int, list[bytes]] = {dim: [] for dim in sizes}
    for r in sorted(sample, key=lambda r: (r["rep"], r["v"])):
        fit[r["dim"]].append(r["v"])
    unit = lambda vs, dim: _units(np.frombuffer(b"".join(vs), width).reshape(-1, dim)) if vs else np.zeros((0, dim))
    return {dim: grow(unit(fit[dim], dim), n, trees) for dim, n in sizes.items()}


def near_vectors(vectors: DataFrame, least: float = 0.95, max_sample: int = 20000, trees: int = TREES) -> DataFrame:
    """vectors(vec_id, embedding): vec_id, n_links, component_id and kept, a row for each row."""
    spark, width = vectors.sparkSession, _narrow(vectors)
    prepare(spark)
    made = Stored(_raw(vectors), "vectors")
    sets = made.df.where("dim > 0 AND vec_id IS NOT NULL")
    sized = sets.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.min("v").alias("v"))
    reps = Stored(sized, "reps")
    forests = spark.sparkContext.broadcast(_forests(reps.df, width, max_sample, trees))
    sizes = _indexed(reps.df, forests, width, list(range(trees)), False).groupBy("dim", "tree", "leaf").agg(F.count("*").alias("size"))
    big = Stored(sizes.where(F.col("size") > BLOCK).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size"), "big")
    found = []
    for tree in range(trees):
        rows = _indexed(reps.df, forests, width, [tree], True).join(big.df, ["dim", "tree", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("p", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lo", F.least("p", "o")).withColumn("hi", F.greatest("p", "o"))
        found.append(Stored(_compare(rows.drop("parts", "o", "tree"), forests, width, tree, least), "found"))
        del rows
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of this tree before the next one's
    every = reduce(DataFrame.unionByName, [x.df for x in found])
    counts = every.groupBy("rep").agg(F.sum("links").alias("links"))
    equal = Stored(sets.join(reps.df.select("h1", "h2", "dim", "rep", "n"), ["h1", "h2", "dim"]).select("vec_id", "rep", "n").distinct(), "equal")
    edges = every.where("rep <> other").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    edges = edges.unionByName(equal.df.where("vec_id <> rep").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")))
    label = components_by_star(edges).select(F.col("node").alias("vec_id"), "component")
    links = Stored(equal.df.join(counts, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "links")
    for x in (*found, made, reps, big, equal):
        x.drop()
    out = vectors.select("vec_id").join(links.df, "vec_id", "left").join(label, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
