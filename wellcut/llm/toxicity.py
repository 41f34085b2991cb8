r"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017), in numpy.

Confirmed toxic examples (P) and unlabelled texts (U) train a linear classifier on words and beginnings of words (present, two, three and five times). With the class prior
p, the risk is  p * R_P(+1) + max(0, R_U(-1) - p * R_P(-1)):  what the unlabelled texts add to the negative risk is
corrected by the share of positives among them, and kept from going below zero, which is what overfitting would do.
The labelled rows that may be learnt from give the prior and, at the end, the scale of the scores (Platt).

Bounds, all parameters: ``max_positive`` toxic, ``max_unlabelled`` unlabelled and ``max_scale`` labelled documents are
sampled by a hash of the id; ``max_features`` words enter the model. Scoring covers every text, whole, in one narrow
pass that carries the few weights along.

Defined results: a null or empty text has no words and gets the score of the intercept; ties and repeated rows score
alike; an empty table gives an empty result; without a single toxic label that may be learnt from, every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, add_columns, prepare, set_aside, texts, words_of
from wellcut.llm.labels import remainder, sampled, with_texts

STRIP = b".,;:!?\"'()[]{}*#$%&|<>~_-"
THRESHOLD = 0.7
CACHE = 100_000
#: Beginnings of words, in characters, and counts in a text that are features beside the words themselves.
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3, 5)
#: A feature enters the model where its share in P is so many times that in U.
RATIO = 2.0


def word_keys(word: bytes) -> tuple[int, ...]:
    """29-bit hashes of a word, in lower case and without punctuation around it, and of its longer beginnings."""
    w = word.strip(STRIP).decode("utf-8", "ignore").lower()
    parts = [w, *(f"^{w[:k]}" for k in PREFIXES if len(w) > k)] if w else []
    return tuple(dict.fromkeys(zlib.crc32(p.encode()) >> 3 for p in parts))


def levels(counts: dict[int, int]) -> list[int]:
    """A feature for each key and each of the LEVELS that its count in the text reaches."""
    return [k << 2 | i for k, n in counts.items() for i, least in enumerate(LEVELS) if n >= least]


def keys_of(text: bytes | None, cache: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Distinct features of a text, ascending."""
    if len(cache) > CACHE:
        cache.clear()
    counts: dict[int, int] = {}
    for w, n in Counter(words_of(text)).items():
        keys = cache.get(w)
        if keys is None:
            keys = cache[w] = word_keys(w)
        for k in keys:
            counts[k] = counts.get(k, 0) + n
    return np.array(sorted(levels(counts)), np.int32)


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    empty: bool = False

    def __post_init__(self) -> None:
        self.keys = {k >> 2 for k in self.weights}

    def score(self, text: bytes | None, cache: dict[bytes, tuple[int, ...]]) -> float:
        if self.empty:
            return 0.0
        if len(cache) > CACHE:
            cache.clear()
        counts: dict[int, int] = {}
        for w, n in Counter(words_of(text)).items():
            keys = cache.get(w)
            if keys is None:
                keys = cache[w] = tuple(k for k in word_keys(w) if k in self.keys)
            for k in keys:
                counts[k] = counts.get(k, 0) + n
        raw = math.fsum(self.weights.get(k, 0.0) for k in levels(counts)) + self.intercept
        z = self.scale[0] * raw + self.scale[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def select_features(pos: list[np.ndarray], unl: list[np.ndarray], most: int, least_docs: int = 3) -> np.ndarray:
    """The features whose share of documents differs most between P and U, in standard errors."""
    up, cp = np.unique(np.concatenate([*pos, np.zeros(0, np.int32)]), return_counts=True)
    uu, cu = np.unique(np.concatenate([*unl, np.zeros(0, np.int32)]), return_counts=True)
    every = np.union1d(up, uu)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, up)], b[np.searchsorted(every, uu)] = cp, cu
    n, m = max(1, len(pos)), max(1, len(unl))
    share = (a + b) / (n + m)
    z = np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-9)
    z[(a + b < least_docs) | (a / n < RATIO * b / m)] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(every[best[z[best] > 2.5]])


def design(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(features)), np.float32)
    for i, keys in enumerate(rows):
        out[i, np.searchsorted(features, np.intersect1d(keys, features, assume_unique=True))] = 1
    return out


def train_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 120, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam on mixed batches.

    First with the logistic loss, which is convex, so that no start is a bad one; then, from there, with the sigmoid loss,
    which texts far on the wrong side don't drag along.
    """
    rng = np.random.default_rng(seed)
    w, b = np.zeros(pos.shape[1]), -1.0
    batches = max(1, min(40, len(unl) // 256))
    for convex in (True, False):
        m1, m2, steps = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
        pace = rate if convex else rate / 2
        for _ in range(epochs):
            for p, u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches), strict=True):
                if not len(p) or not len(u):
                    continue
                x, y = pos[p], unl[u]
                zp, zu = x @ w + b, y @ w + b
                sp, su = _sigmoid(zp), _sigmoid(zu)
                if convex:  # l(z, +1) = log(1 + exp(-z)), l(z, -1) = log(1 + exp(z))
                    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                    plus, minus_p, minus_u = sp - 1, sp, su
                else:  # l(z, +1) = 1 - s(z), l(z, -1) = s(z)
                    negative = su.mean() - prior * sp.mean()
                    plus, minus_p, minus_u = -sp * (1 - sp), sp * (1 - sp), su * (1 - su)
                if negative >= 0:
                    gp, gu = prior * (plus - minus_p) / len(p), minus_u / len(u)
                else:  # the correction: step back along the negative part only
                    gp, gu = prior * minus_p / len(p), -minus_u / len(u)
                grad = np.append(x.T @ gp + y.T @ gu + (decay if convex else decay / 10) * w, gp.sum() + gu.sum())
                steps += 1
                m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
                step = pace * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
                w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift so that sigmoid(slope * z + shift) fits the labels; the slope is kept positive."""
    if not len(z) or y.all() or not y.any():
        return 1.0, 0.0
    sd = max(float(z.std()), 1e-6)
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0 / sd, -float(z.mean()) / sd
    for _ in range(60):
        p = _sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -5, 5))
        if np.abs(d).max() < 1e-7:
            break
    return (a, b) if a > 0 else (1.0 / sd, -float(z.mean()) / sd)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2500, max_unlabelled: int = 6000, max_scale: int = 3000, max_features: int = 300) -> Model:
    """Trains on docs(doc_id, text) and labels(doc_id, toxic), where crc32(doc_id) mod 3 is not 1."""
    prepare(docs.sparkSession)
    known = labels.where((remainder("doc_id", 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    if not counts["p"]:
        return Model(empty=True)
    prior = min(0.9, max(counts["p"] / counts["n"], 1e-4))
    # role: 0 labelled for the scale, 1 confirmed toxic, 2 unlabelled (any document; its label, if any, isn't looked at)
    mark = lambda rows, most, role, y: sampled(rows.select("doc_id"), most).select("doc_id", F.lit(role).alias("role"), F.lit(y).alias("y"))
    sample = mark(known.where("toxic = 1"), max_positive, 1, 1).unionByName(mark(docs, max_unlabelled, 2, 0)).unionByName(
        mark(known.where("toxic <> 1"), max_scale, 0, 0))
    roles = sample.groupBy("doc_id").agg(F.collect_set("role").alias("roles"), F.max("y").alias("y"))
    cache: dict[bytes, tuple[int, ...]] = {}
    made = add_columns(with_texts(docs, roles), [("keys", T.BinaryType())], lambda b: [pa.array([keys_of(x, cache).tobytes() for x in texts(b)], pa.binary())], ["text", "roles", "y"])
    rows = [(np.frombuffer(r[f"{ADDED}keys"], np.int32), set(r["roles"]), r["y"]) for r in made.select(f"{ADDED}keys", "roles", "y").collect()]
    pos, unl = [k for k, r, _ in rows if 1 in r], [k for k, r, _ in rows if 2 in r]
    if not pos or not unl:
        return Model(empty=True)
    features = select_features(pos, unl, max_features)
    w, b = train_nnpu(design(pos, features), design(unl, features), prior)
    scale = [(k, y) for k, r, y in rows if r & {0, 1}]
    z = design([k for k, _ in scale], features) @ w + b
    return Model({int(k): float(v) for k, v in zip(features, w, strict=True)}, b, platt(z, np.array([y == 1 for _, y in scale], bool)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with the column wc__score; one narrow pass."""
    prepare(docs.sparkSession)
    cache: dict[bytes, tuple[int, ...]] = {}
    return add_columns(docs, [("score", T.DoubleType())], lambda b: [pa.array([model.score(x, cache) for x in texts(b)], pa.float64())], keep)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    made = score(docs, train(docs, labels, **bounds), ["doc_id", "text"])
    s = F.col(f"{ADDED}score")
    return made.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    plain, own = set_aside(docs)
    return own(score(plain, train(docs, labels, **bounds)).where(F.col(f"{ADDED}score") < THRESHOLD))
