r"""Line dedup by winnowing over line hashes.

The lines of a document (those with a word) are hashed. A gram is a shortest run of lines with at least ``GRAM`` words
from a given line on; a window is a shortest run with at least ``least`` words. In each window the gram with the
smallest hash is selected, and only selected grams are fingerprints: equal windows select equal grams, so two documents
that share a run of ``least`` words or more share a fingerprint, wherever the run lies in them.

Each fingerprint's first position, in the order of id and line, is its anchor. Later positions are joined with it, one
row for each pair of documents, and extended both ways over equal lines. A matched run of at least ``least`` words is
deleted from the later document. Where a fingerprint's match with its anchor doesn't hold all windows that selected it,
these windows are matched in the same way, each with the first position of that window. So the lines of every window
that occurred before are deleted, each first occurrence stays, and no pair of later positions is ever formed: work grows
with the positions, however many documents share a line.

Defined results: a null or empty text stays as it is; lines without a word are never matched and go only between deleted
lines of one run; lines are equal where their words are, whatever the white space; rows that repeat an id with the same
text are one document and change alike; rows without an id stay as they are; documents that lose every line keep an
empty text; an empty table gives an empty result; other columns are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, prepare, set_aside, slices, texts
from wellcut.llm.id_filter import split_by_ids
from wellcut.session import Stored

LEAST = 50
GRAM = 25
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def lines_of(text: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All lines; then number, hash and words of those with a word."""
    raw = text.split(b"\n") if text else []
    at, hashes, words = [], [], []
    for k, line in enumerate(raw):
        ws = line.split()
        if ws:
            at.append(k)
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(ws)))
            words.append(len(ws))
    return raw, np.array(at, np.int64), np.array(hashes, np.uint64), np.array(words, np.int64)


def runs(words: np.ndarray, least: int) -> np.ndarray:
    """The last line of the shortest run with at least ``least`` words from each line on; the number of lines where there is none."""
    total = np.cumsum(words)
    return np.searchsorted(total, total - words + least, "left")


def run_hashes(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run i..last[i], for the first len(last) lines."""
    n = len(hashes)
    one = np.ones(1, np.uint64)
    power, back = (np.cumprod(np.concatenate([one, np.full(n, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])
    i = np.arange(len(last))
    x = (sums[last + 1] - sums[i]) * back[i] + (last + 1 - i).astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def winnow(hashes: np.ndarray, words: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window, by its first line: its last line and the line where its smallest gram begins; and all gram hashes."""
    end, stop = runs(words, gram), runs(words, least)
    end, stop = end[end < len(words)], stop[stop < len(words)]
    g = run_hashes(hashes, end)
    s = np.arange(len(stop))
    last = np.searchsorted(end, stop, "right") - 1  # the last gram that ends in the window
    pick = s.copy()
    for k in range(1, int((last - s).max(initial=0)) + 1):
        at = np.minimum(s + k, last)
        pick = np.where(g[at] < g[pick], at, pick)
    return stop, pick, g


def _lines(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Documents with a window: id, hash of the text, hashes and words of the lines, fingerprints."""
    prepare(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("h", "w", "at")], T.StructField("g", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, out = [], []
            for k, x in enumerate(texts(b)):
                _, _, h, w = lines_of(x)
                if not len(w) or w.sum() < least:
                    continue
                stop, pick, g = winnow(h, w, least, gram)
                # a position with the first line and the last line of the windows that selected it
                order = np.argsort(pick, kind="stable")
                at, begin = np.unique(pick[order], return_index=True)
                low, high = np.minimum.reduceat(order, begin), np.maximum.reduceat(stop[order], begin)
                rows.append(k)
                out.append((text_hash(x), h.tobytes(), w.astype(np.int32).tobytes(), np.stack([at, low, high], 1).astype(np.int32).tobytes(), g[at].view(np.int64).tolist()))
            if rows:
                cols = list(zip(*out, strict=True))
                arrays = [b.column("doc_id").take(pa.array(rows)), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:4]), pa.array(cols[4], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, schema)


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _position_schema(lines: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("g", T.LongType()), lines.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("th", "i", "low", "high")]])


def _matched(positions: DataFrame, lines: DataFrame) -> Stored:
    """positions of _position_schema, joined with the first position of each g and extended: (doc_id, th, g, lo, hi, words, whole).

    Lines lo..hi match; whole tells whether they hold all windows low..high of the position. Documents are compared
    once for each pair of a document and an anchor's document.
    """
    # counted by partial aggregates and written down, as the anchors' lines are: a join's side with a hot key can then be split
    first = Stored(positions.groupBy("g").agg(F.min(F.struct("doc_id", "th", "i")).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    own = lines.select("doc_id", "th", "h", "w").dropDuplicates(["doc_id", "th"])
    anchors = first.df.select("a.doc_id", "a.th").distinct()
    other = Stored(own.join(anchors, ["doc_id", "th"], "left_semi").select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("h").alias("a_h")), "anchors")
    later = positions.join(first.df, "g").where("struct(doc_id, th, i) <> a")
    pairs = later.groupBy("doc_id", "th", F.col("a.doc_id").alias("a_id"), F.col("a.th").alias("a_th")).agg(F.collect_set(F.struct("g", "i", "low", "high", F.col("a.i").alias("ai"))).alias("m"))
    both = pairs.join(own, ["doc_id", "th"]).join(other.df, ["a_id", "a_th"]).select("doc_id", "th", "h", "w", "a_h", "m")
    schema = T.StructType([lines.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("th", "g", "lo", "hi", "words")], T.StructField("whole", T.BooleanType())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for k, r in enumerate(b.to_pylist()):
                h, a = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["a_h"], np.uint64)
                total = np.concatenate([[0], np.cumsum(np.frombuffer(r["w"], np.int32), dtype=np.int64)])
                known: dict[int, tuple[np.ndarray, int]] = {}
                for m in r["m"]:
                    d = m["i"] - m["ai"]
                    if d not in known:  # lines from..: whether the two documents differ on this diagonal
                        start = max(0, d)
                        size = min(len(h), len(a) + d) - start
                        differ = np.flatnonzero(h[start : start + size] != a[start - d : start - d + size]) + start
                        known[d] = np.concatenate([[start - 1], differ, [start + size]]), start
                    edge = known[d][0]
                    j = np.searchsorted(edge, m["i"])
                    lo, hi = int(edge[j - 1]) + 1, int(edge[j]) - 1
                    if hi >= lo:
                        ids.append(k)
                        out.append((r["th"], m["g"], lo, hi, int(total[hi + 1] - total[lo]), lo <= m["low"] and m["high"] <= hi))
            if ids:
                *numbers, whole = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids)), *(pa.array(c, pa.int64()) for c in numbers), pa.array(whole)], names=schema.names)

    found = Stored(both.mapInArrow(extend, schema), "runs")
    first.drop()
    other.drop()
    return found


def _windows(positions: DataFrame, lines: DataFrame, least: int, gram: int) -> DataFrame:
    """The whole windows, with their own hashes as g, that selected one of positions(doc_id, th, i)."""
    some = positions.groupBy("doc_id", "th").agg(F.collect_set("i").alias("picked"))
    rows = lines.select("doc_id", "th", "h", "w").dropDuplicates(["doc_id", "th"]).join(some, ["doc_id", "th"])
    schema = _position_schema(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, r in enumerate(b.select(["th", "h", "w", "picked"]).to_pylist()):
                h, w = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["w"], np.int32).astype(np.int64)
                stop, pick, _ = winnow(h, w, least, gram)
                s = np.flatnonzero(np.isin(pick, r["picked"]))
                g = run_hashes(h, stop)[s].view(np.int64)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(g), b.column("doc_id").take(pa.array([k] * n, pa.int64())), pa.array([r["th"]] * n, pa.int64()), pa.array(s), pa.array(s), pa.array(stop[s])], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of its text) and spans: runs of lines (lo, hi), counted among lines with a word, that occurred before."""
    gram = min(gram, least)
    lines = Stored(_lines(docs, least, gram), "lines")
    positions = _positions(lines.df)
    one = _matched(positions, lines.df)
    unsure = Stored(one.df.where("NOT whole").select("g").distinct(), "unsure")
    again = positions.join(unsure.df, "g", "left_semi").select("doc_id", "th", "i")
    two = _matched(_windows(again, lines.df, least, gram), lines.df)
    sure = one.df.unionByName(two.df).where(F.col("words") >= least)
    spans = Stored(sure.groupBy("doc_id").agg(F.collect_set(F.struct("th", "lo", "hi")).alias("spans")), "spans")
    for x in (lines, one, unsure, two):
        x.drop()
    return spans.df


def _positions(lines: DataFrame) -> DataFrame:
    """The fingerprints: hash, document, line, first and last line of the windows that selected it."""
    schema = _position_schema(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.frombuffer(x, np.int32).reshape(-1, 3).astype(np.int64) for x in b.column("at").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]))
            i, low, high = np.concatenate([*at, np.zeros((0, 3), np.int64)]).T
            yield pa.RecordBatch.from_arrays([b.column("g").flatten(), b.column("doc_id").take(row), b.column("th").take(row), *map(pa.array, (i.copy(), low.copy(), high.copy()))], names=schema.names)

    return lines.select("doc_id", "th", "at", "g").mapInArrow(run, schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the lines of the spans, the number of its lines with a word, and how many of these went."""
    raw, at, _, _ = lines_of(text)
    gone, n = np.zeros(len(raw), bool), np.zeros(len(at), bool)
    for lo, hi in spans:
        gone[at[lo] : at[hi] + 1] = True
        n[lo : hi + 1] = True
    return b"\n".join(x for x, g in zip(raw, gone, strict=True) if not g), len(at), int(n.sum())


def keep_first(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with the deduplicated text, and no other change."""
    plain, own = set_aside(docs)
    return own(dedup(plain, least, gram))


def dedup(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with the deduplicated text; wc__n_lines and wc__n_removed are added, columns that begin like these go."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith(ADDED)])
    spans = repeated_runs(docs, least, gram)
    # only documents that may lose lines are shuffled
    clear, rest = split_by_ids(docs, spans.select("doc_id"))
    spans = spans.withColumnsRenamed({"doc_id": f"{ADDED}id", "spans": f"{ADDED}spans"})
    found = rest.join(spans, F.col("doc_id") == F.col(f"{ADDED}id"), "left").drop(f"{ADDED}id")
    rows = clear.withColumn(f"{ADDED}spans", F.lit(None).cast(spans.schema[f"{ADDED}spans"].dataType)).unionByName(found)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{ADDED}n_lines", T.LongType()), T.StructField(f"{ADDED}n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made, n, gone = [], [], []
            for x, found in zip(texts(b), b.column(f"{ADDED}spans").to_pylist(), strict=True):
                th = text_hash(x) if found else 0
                own = [(s["lo"], s["hi"]) for s in found or () if s["th"] == th]
                if own:
                    x, lines, removed = without(x, own)
                else:
                    lines, removed = len([y for y in x.split(b"\n") if y.split()]) if x else 0, 0
                made.append(x)
                n.append(lines)
                gone.append(removed)
            cols = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array([None if x is None else x.decode("utf-8") for x in made], pa.string())}
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in names], pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, of every document."""
    made = dedup(docs.select("doc_id", "text"), least)
    return made.select("doc_id", F.col(f"{ADDED}n_lines").alias("n_lines"), F.col(f"{ADDED}n_removed").alias("n_removed"), "text")
