r"""Near-duplicate documents by MinHash with odd sketches (Mitzenmacher, Pagh and Pham 2014).

A document is the set of its distinct word shingles; two documents are linked where 100 * |A and B| >= percent *
|A or B|, and the result is one row per document with the component of the links.

1. One narrow pass makes, for each document, the set's size and 128-bit fingerprint, ``BANDS`` keys of ``ROWS`` MinHash
   samples, and the odd sketch: a bitmap of ``BITS`` bits in which each of the samples flips one bit.
2. Equal sets collapse to a class with the smallest id as representative, before anything is paired.
3. Representatives that share a band key are candidates. Each bucket is first paired as a star with its smallest member,
   so hot buckets cost a row for each member. The XOR of two sketches has a population count that tells how many samples
   differ; pairs that are surely below the threshold go. The rest is confirmed on the full sets.
4. Buckets whose members still lie in different components are compared in full, members of different components only,
   in blocks that are spread over tasks: sketches first, then full sets by an inverted index of the block. One link of
   a member to a component is returned. So no component is missed inside a bucket, no cap is needed, and the rows that
   come out stay in proportion to the members.
5. Components of the confirmed links, by alternating stars.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7, and the sketch test drops it with
a probability of about that size.

Defined results: a text without words, or a null one, has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; rows that repeat an id are one document; a row without an id is linked with nothing
and kept; ties take the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, add_columns, prepare, slices, texts
from wellcut.llm.id_filter import hits, id_filter, split_by_ids
from wellcut.operators.components import components_by_star
from wellcut.session import Stored

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
CACHE = 150_000
#: Members of a bucket that a task compares with as many others.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


MULTIPLY, ADD = _constants(SAMPLES, 101), _constants(SAMPLES, 102)
POSITION = _constants(64, 103)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    words = text.lower().split() if text else []  # bytes: lowers A-Z only, cuts at ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    for w in {w for w in words if w not in cache}:
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * POSITION[j]
    return np.unique(mix(total + np.uint64(n)))


def samples(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a non-empty set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * MULTIPLY
        part += ADD
        np.minimum(low, part.min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    rows = mix(low.reshape(BANDS, ROWS))
    key = (rows * POSITION[:ROWS]).sum(1, dtype=np.uint64)
    return mix(key + POSITION[8 : 8 + BANDS]).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The samples folded into BITS parities, as BITS / 64 words."""
    bit = (mix(low + np.arange(SAMPLES, dtype=np.uint64) * POSITION[40]) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_flips(percent: int) -> int:
    """The population count of the XOR that a pair at the threshold exceeds with a probability of about 1e-7."""
    j = percent / 100
    differ = SAMPLES * (1 - j) + 5.2 * (SAMPLES * j * (1 - j)) ** 0.5
    mean = BITS * (1 - (1 - 2 / BITS) ** (2 * differ)) / 2
    return int(np.ceil(mean + 2 * (mean / 2) ** 0.5))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2, bands and sketch of each row; the last four are null for empty sets."""
    prepare(docs.sparkSession)
    cache: dict[bytes, int] = {}

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        n, h, bands, sketch = [], [], [], []
        for x in texts(b):
            s = shingle_set(x, width, cache)
            n.append(len(s))
            if len(s):
                low = samples(s)
                h.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())
                bands.append(band_keys(low))
                sketch.append(odd_sketch(low))
            else:
                h.append((None, None))
                bands.append(None)
                sketch.append(None)
        longs = pa.list_(pa.int64())
        return [pa.array(n, pa.int64()), *(pa.array([x[i] for x in h], pa.int64()) for i in (0, 1)), pa.array(bands, longs), pa.array(sketch, longs)]

    many = T.ArrayType(T.LongType())
    made = add_columns(docs, [("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("bands", many), ("sketch", many)], run, ["doc_id", "text"])
    return made.select("doc_id", *[F.col(ADDED + c).alias(c) for c in ("n", "h1", "h2", "bands", "sketch")])


def _flips(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes allow the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(sized & (_flips("sa", "sb") <= most_flips(percent))).select("a", "b")


def _sets(ids: DataFrame, docs: DataFrame, width: int) -> Stored:
    """(doc_id, set) of the documents with these ids, and a few more: their full sets, as ascending 64-bit hashes.

    The ids reach the scan as a Bloom filter, so that no text is shuffled; where there are too many, they are joined.
    """
    sent = id_filter(ids)
    cache: dict[bytes, int] = {}
    schema = T.StructType([docs.schema["doc_id"], T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hit = np.ones(b.num_rows, bool) if sent is None else hits(sent.value, b.column("h"))
            if hit.any():
                b = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_set(x, width, cache).tobytes() for x in texts(b)], pa.binary())], names=schema.names)

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    rows = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi") if sent is None else rows
    return Stored(rows.mapInArrow(run, schema), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> Stored:
    """The pairs (a, b) whose full sets reach the threshold."""
    kept = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, width)
    side = lambda x: kept.df.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer() or b"", np.uint64), np.frombuffer(y.as_buffer() or b"", np.uint64)
                at = np.searchsorted(p, q) if len(p) else np.zeros(0, int)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum()) if len(p) else 0
                ok.append(100 * common >= percent * (len(p) + len(q) - common) and common > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = Stored(both.mapInArrow(check, pairs.select("a", "b").schema).distinct(), "links")
    kept.drop()
    return links


class Inverted:
    """Shingle to the rows of a block that have it."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.values, self.owner, self.n = every[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], len(sets)

    def common(self, s: np.ndarray) -> np.ndarray:
        """Shingles that a set has in common with each row."""
        lo, hi = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a task, and whether they are one and the same."""
    return pdf[pdf["p"] == pdf["lo"]], pdf[pdf["p"] == pdf["hi"]], bool(pdf["lo"].iloc[0] == pdf["hi"].iloc[0])


def _across(members: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> Stored:
    """Links (a, b) between members(key, rep, c, n) of a key whose components c differ.

    A key's members are compared in blocks of at most about BLOCK rows and BLOCK_SHINGLES shingles, each pair of blocks
    in a task of its own. Sizes and sketches go first and leave the rows that take part in a pair that may be a link;
    a pair that shares several keys is looked at in the first band they share. Only those rows are joined with their
    full sets, which decide. Of the links of a member to one component, one is returned: more would join nothing more.
    """
    # written down, so that the join's large side can be split where a key is hot
    sized = Stored(members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")), "sized")
    rows = members.join(sized.df, "key").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # part p meets part o: the row goes to every unordered pair of parts that holds its own
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("lo", F.least("p", "o")).withColumn("hi", F.greatest("p", "o")).drop("o", "parts")
    flips = most_flips(percent)
    columns = ["key", "lo", "hi", "p", "rep", "c", "n", "sketch"]

    def pairs(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of left, and the rows of right that sizes, sketches and components allow to be linked with each."""
        words = lambda x: np.stack(x["sketch"].to_list()).astype(np.int64).view(np.uint64)
        sa, sb = words(left), words(right)
        ra, rb, ca, cb, na, nb = (x[c].to_numpy() for c in ("rep", "c", "n") for x in (left, right))
        for i in range(len(ra)):
            ok = (cb != ca[i]) & (100 * np.minimum(na[i], nb) >= percent * np.maximum(na[i], nb))
            if same:
                ok &= rb > ra[i]
            at = np.flatnonzero(ok)
            if len(at):
                at = at[np.bitwise_count(sb[at] ^ sa[i]).sum(1, dtype=np.int64) <= flips]
            if len(at):
                yield i, at

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        if left.empty or right.empty:
            return pdf[columns].iloc[:0]
        ba, bb = (np.stack(x["bands"].to_list()).astype(np.int64) for x in (left, right))
        band = int(np.flatnonzero(ba[0] == np.int64(pdf["key"].iloc[0]))[0])
        hit_a, hit_b = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for i, at in pairs(left, right, same):
            at = at[~(bb[at, :band] == ba[i, :band]).any(1)]
            hit_a[i] = len(at) > 0
            hit_b[at] = True
        hit_a, hit_b = (hit_a | hit_b,) * 2 if same else (hit_a, hit_b)
        return left[hit_a][columns] if same else pd.concat([left[hit_a], right[hit_b]])[columns]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        sets = lambda x: [np.frombuffer(v, np.uint64) for v in x["set"]]
        out: list[tuple] = []
        if not left.empty and not right.empty:
            own, index = sets(left), Inverted(sets(right))
            ra, rb, cb, na, nb = left["rep"].to_numpy(), right["rep"].to_numpy(), right["c"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
            for i, at in pairs(left, right, same):
                common = index.common(own[i])[at]
                at = at[100 * common >= percent * (na[i] + nb[at] - common)]
                out += [(min(ra[i], rb[j]), max(ra[i], rb[j])) for j in at[np.unique(cb[at], return_index=True)[1]]]
        return pd.DataFrame(out or {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}, columns=["a", "b"])

    types = dict(members.dtypes) | {"lo": "int", "hi": "int", "p": "int", "sketch": "array<bigint>"}
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    narrow = rows.join(reps.select("rep", "bands", "sketch"), "rep")
    left = Stored(narrow.groupBy("key", "lo", "hi").applyInPandas(likely, schema), "likely")
    full = _sets(left.df.select(F.col("rep").alias("doc_id")), docs, width)
    fat = left.df.join(full.df.withColumnRenamed("doc_id", "rep"), "rep")
    found = Stored(fat.groupBy("key", "lo", "hi").applyInPandas(links, f"a {types['rep']}, b {types['rep']}").distinct(), "across")
    for x in (sized, left, full):
        x.drop()
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    made = Stored(signatures(docs, width), "signatures").df
    sets = made.where("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    equal = sets.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).distinct()
    # one row for each class: where an id is repeated with other texts, the fingerprint tells them apart
    reps = Stored(sets.join(classes.drop("n"), ["h1", "h2"]).where("doc_id = rep").dropDuplicates(["h1", "h2"]).select("rep", "n", "bands", "sketch"), "reps")
    keys = reps.df.select("rep", "n", F.explode("bands").alias("key"))
    # keys are counted by partial aggregates; the counts are written down, so that the join's side of the keys can be split
    full = Stored(keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1"), "sizes")
    members = Stored(keys.join(full.df, "key").select("key", "rep", "n", "center", "size"), "buckets")
    stars = members.df.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    likely = Stored(_likely(stars, reps.df, percent), "stars")
    links = _confirmed(likely.df, docs, width, percent)
    found = Stored(components_by_star(links.df.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "found")
    # buckets of three or more whose members still lie in different components: all pairs but those with the centre
    big = members.df.where("size > 2 AND rep <> center").join(found.df.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    split = Stored(big.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "split")
    rest = Stored(big.join(split.df, "key"), "rest")
    more = _across(rest.df, reps.df, docs, width, percent)
    edges = links.df.unionByName(more.df).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(equal)
    label = components_by_star(edges).select(F.col("node").alias("doc_id"), "component")
    for x in (reps, full, members, likely, links, found, split, rest, more):
        x.drop()
    rows = made.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all rows without an id.

    Of rows that repeat an id with the same text one stays, the first in the order of all columns; rows that repeat an id
    with other texts are one document and stay or go together. Columns of any names come along.
    """
    rows = Stored(near_duplicates(docs, width, percent), "near").df
    gone = rows.where("NOT kept").select("doc_id").distinct()
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    ids = Stored(gone.withColumn("gone", F.lit(True)).unionByName(repeated.withColumn("gone", F.lit(False))).groupBy("doc_id").agg(F.max("gone").alias("gone")), "gone").df
    # only rows that may be among these ids are shuffled
    clear, rest = split_by_ids(docs, ids)
    columns = [f"`{c}`" for c in docs.columns]
    once = rest.join(ids, "doc_id", "left_anti").select(*columns)
    whole = F.struct(*columns)
    again = rest.join(ids.where("NOT gone"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select(*[f"row.{c}" for c in columns])
    return clear.unionByName(once).unionByName(again)
