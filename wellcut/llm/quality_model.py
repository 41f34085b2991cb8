r"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Word pieces (runs of letters, of digits, of other characters) hash to ``BUCKETS`` rows. Each row has a sparse random
index vector of ``DIM`` components; the context vector of a row is the sum of the index vectors of its neighbours,
within two pieces, over every document of the table. Tasks sum what they see into their own matrix and only matrices
are merged, so the table of vectors has a fixed size (BUCKETS x DIM) and what is shuffled is that size for each task.
Where a corpus has many more pieces than BUCKETS, a row is the context of all pieces that hash to it: rare pieces then
say little beside a frequent one. BUCKETS bounds the model, not the text that is read.

A document is pooled to the mean and the spread of its pieces' unit vectors and the mean step from one to the next; a
network with one hidden layer, trained on a bounded sample of labelled documents (``max_labelled``), gives a logit, and
a temperature and shift fitted on a part of the sample that training doesn't see calibrate it.

Defined results: a null or empty text pools to zeros and gets the score the network gives for that; repeated rows score
alike; an empty table gives an empty result; without labels of both kinds that may be learnt from, every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, add_columns, prepare, slices, texts
from wellcut.llm.labels import remainder, sampled, with_texts

BUCKETS = 1 << 15
DIM = 32
REACH = 2
#: Components of an index vector that aren't zero.
ONES = 4
THRESHOLD = 0.3
#: Bytes of a text that are cut into pieces at a time.
BLOCK_BYTES = 1 << 20
#: Kinds of bytes: 0 space, 1 letter or part of a character beyond ASCII, 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
#: A piece's hash is the sum of its bytes' numbers times those of their places.
BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64)
PLACE = np.random.default_rng(6).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Pieces that a task gathers before it adds them to its matrix.
FLUSH = 1 << 21
#: Pieces whose vectors are pooled at a time.
POOL = 1 << 16
#: Rows of the matrix that travel together, and parts of the first round of the merge.
SEGMENT = 512
FAN = 32


def index_codes(buckets: int = BUCKETS, dim: int = DIM, seed: int = 11) -> np.ndarray:
    """Sparse ternary index vectors: ONES times the place of a component, plus ``dim`` where it is -1."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, dim, (ONES, buckets)) + dim * rng.integers(0, 2, (ONES, buckets))).astype(np.int32)


def bucket_ids(text: bytes | None) -> np.ndarray:
    """The row of each piece of a text: bytes are sorted into kinds, runs of a kind are pieces, and those of spaces go."""
    out, at, size = [], 0, BLOCK_BYTES
    while text and at < len(text):
        x = np.frombuffer(text, np.uint8, min(size, len(text) - at), at)
        kind = KIND[x]
        edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        if at + len(x) < len(text):  # the last run may go on: it begins the next block
            if len(edge) == 1:
                size *= 2
                continue
            x, edge = x[: edge[-1]], edge[:-1]
        place = np.arange(len(x)) - np.repeat(edge, np.diff(np.append(edge, len(x))))
        h = np.add.reduceat(BYTE[x] * PLACE[place % len(PLACE)], edge)[kind[edge] != 0]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32))
        at, size = at + len(x), BLOCK_BYTES
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def contexts(ids: list[np.ndarray], codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The sum of the index vectors of the neighbours of each row's pieces, rows x dim; documents are kept apart by gaps.

    Each component of a neighbour's index vector is one cell of (row, place, sign), so a sum is a count of cells.
    """
    rows = codes.shape[1]
    gap = np.full(REACH, -1, np.int32)
    row = np.concatenate([x for i in ids for x in (i, gap)])
    cells = np.zeros(rows * 2 * dim, np.int64)
    for d in range(1, REACH + 1):
        a, b = row[:-d], row[d:]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        for own, other in ((a, b), (b, a)):
            base = own * np.int32(2 * dim)
            for code in codes:
                cells += np.bincount(base + code[other], minlength=len(cells))
    cells = cells.reshape(rows, 2, dim)
    return cells[:, 0] - cells[:, 1]


def _merged(parts: DataFrame) -> DataFrame:
    """(segment, salt, v): the parts of a partition summed by segment, as they stream by; integers, so in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("segment").to_pylist(), b.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), np.int64)
                total[k] = total[k] + x if k in total else x.copy()
        if total:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["segment", "salt", "v"])

    return parts.mapInArrow(run, parts.schema)


def context_sums(docs: DataFrame) -> np.ndarray:
    """The sums of ``contexts`` over all documents.

    A task sends its matrix in segments. They are merged in two rounds, FAN parts of each segment first, so that no task
    streams what all the others made, and a task holds one matrix at most.
    """
    prepare(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, into = index_codes(), np.zeros((BUCKETS, DIM), np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in slices(batches):
            for x in texts(b):
                held.append(bucket_ids(x))
                size += len(held[-1])
                if size >= FLUSH:
                    into += contexts(held, codes)
                    held, size = [], 0
        if size:
            into += contexts(held, codes)
        salt = TaskContext.get().partitionId() % FAN
        for k, part in enumerate(into.reshape(-1, SEGMENT, DIM)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([salt], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["segment", "salt", "v"])

    parts = docs.select("text").mapInArrow(sums, "segment long, salt long, v binary")
    out = np.zeros((BUCKETS // SEGMENT, SEGMENT, DIM), np.int64)
    for r in _merged(_merged(parts.repartition("segment", "salt")).repartition("segment")).collect():  # one row a segment: BUCKETS x DIM numbers
        out[r["segment"]] = np.frombuffer(r["v"], np.int64).reshape(SEGMENT, DIM)
    return out.reshape(BUCKETS, DIM)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors over all documents: BUCKETS x DIM, as unit vectors; rows that never occur are zero."""
    out = context_sums(docs).astype(np.float64)
    out -= (out.sum(0) / max(1.0, np.abs(out).sum())) * np.abs(out).sum(1, keepdims=True)  # what all rows share says nothing
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def pool(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's pieces, and the mean step from each to the next, by component."""
    total = np.zeros((3, DIM))
    ids = bucket_ids(text)
    for i in range(0, len(ids), POOL):
        v = vectors[ids[i : i + POOL + 1]]  # the next block's first piece comes along, for the step to it
        one, own = np.ones(len(v), np.float32), v[:POOL]
        total += one[: len(own)] @ own, one[: len(own)] @ (own * own), one[1:] @ np.abs(v[1:] - v[:-1])
    n = max(1, len(ids))
    mean = total[0] / n
    return np.concatenate([mean, np.sqrt(np.maximum(total[1] / n - mean * mean, 0)), total[2] / max(1, len(ids) - 1)]).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...] | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature + self.offset, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Model:
    """Two layers by Adam on the log loss; a quarter of the rows fits temperature and offset."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    held = rng.random(len(y)) < 0.25
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held].astype(float)
    m = Model(np.zeros(0), shift=xt.mean(0), scale=xt.std(0) + 1e-3)
    p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z0 = (xt - m.shift) / m.scale
    batches = max(1, min(40, len(yt) // 128))
    for epoch in range(epochs):
        for idx in np.array_split(rng.permutation(len(yt)), batches):
            a, b = z0[idx], yt[idx]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - b) / len(idx)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [a.T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    m.layers = tuple(p)
    use = held if held.any() else np.ones(len(y), bool)
    z, yh = m.logits(x[use]), y[use].astype(bool)
    best = (math.inf, 1.0, 0.0)
    for temp in np.geomspace(0.25, 6, 30):
        for off in np.linspace(-2, 2, 17):
            q = 1 / (1 + np.exp(-np.clip(z / temp + off, -40, 40)))
            loss = -np.log(np.where(yh, q, 1 - q) + 1e-9).mean()
            best = min(best, (loss, float(temp), float(off)))
    _, m.temperature, m.offset = best
    return m


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12000) -> Model:
    """Vectors from all docs(doc_id, text); the network from labels(doc_id, quality) where crc32(doc_id) mod 5 is not 0."""
    vectors = context_vectors(docs)
    known = labels.where((remainder("doc_id", 5) != 0) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # half of the sample for each label: the rarer one isn't drowned
    sample = sampled(known.where("quality = 1"), max_labelled // 2).unionByName(sampled(known.where("quality <> 1"), max_labelled // 2))
    sample = sample.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    made = add_columns(with_texts(docs, sample), [("x", T.BinaryType())], lambda b: [pa.array([pool(x, vectors).tobytes() for x in texts(b)], pa.binary())], ["text", "quality"])
    rows = sorted((r[f"{ADDED}x"], r["quality"]) for r in made.select(f"{ADDED}x", "quality").collect())
    y = np.array([q == 1 for _, q in rows], bool)
    if not len(y) or y.all() or not y.any():
        return Model(vectors)
    m = train_network(np.stack([np.frombuffer(x, np.float32) for x, _ in rows]), y)
    m.vectors = vectors
    # the sample's share of good documents is not the corpus'
    m.offset += math.log(max(share, 1e-3) / max(1 - share, 1e-3)) - math.log(y.mean() / (1 - y.mean()))
    return m


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with the column wc__score; one narrow pass. The model is BUCKETS x DIM numbers and two small layers."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(b: pa.RecordBatch) -> list[pa.Array]:
        m = sent.value
        return [pa.array(m.scores(np.stack([pool(x, m.vectors) for x in texts(b)])))]

    return add_columns(docs, [("score", T.DoubleType())], scores, keep)


def quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    made = score(docs, train(docs, labels, **bounds), ["doc_id", "text"])
    s = F.col(f"{ADDED}score")
    return made.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
