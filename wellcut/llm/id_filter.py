"""Ids taken to a scan as a Bloom filter, so that tables with texts needn't be shuffled.

The filter has BITS_EACH bits for each id, MOST_BITS at most (32 MB, for 16 million ids). It is made in parts by tasks, joined
segment by segment, and sent to every task. It lets every id through that it holds, and about one in sixty of the others,
which costs time and changes no result, because what passes is joined exactly afterwards. More ids than that are joined with
the table by a shuffle instead: a full filter would let all rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellcut.llm.common import prepare
from wellcut.session import Stored

BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SEGMENT = 8192


def _places(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & (n_bits - 1), (h >> 32) & (n_bits - 1)


def hits(bits: np.ndarray, h: pa.Array) -> np.ndarray:
    """Which hashes the filter lets through."""
    a, b = _places(h.to_numpy(zero_copy_only=False), 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def id_filter(ids: DataFrame) -> Broadcast | None:
    """The filter of ids(doc_id), broadcast; None where there are too many."""
    chosen = Stored(ids.select("doc_id").distinct().select(F.xxhash64("doc_id").alias("h")), "ids")
    n_bits = max(LEAST_BITS, 1 << max(0, BITS_EACH * chosen.df.count() - 1).bit_length())
    if n_bits > MOST_BITS:
        chosen.drop()
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column("h").to_numpy(), n_bits):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = bits.reshape(-1, SEGMENT)
        used = np.flatnonzero(rows.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([r.tobytes() for r in rows[used]], pa.binary())], names=["segment", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("segment").to_pylist(), b.column("bits"), strict=True):
                total[k] = np.frombuffer(x.as_buffer(), np.uint8) | total.get(k, np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["segment", "bits"])

    kind = "segment long, bits binary"
    out = np.zeros((n_bits // 8 // SEGMENT, SEGMENT), np.uint8)
    for r in chosen.df.mapInArrow(part, kind).repartition("segment").mapInArrow(join, kind).collect():  # n_bits in all
        out[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    chosen.drop()
    return ids.sparkSession.sparkContext.broadcast(out.reshape(-1))


def _unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose id is surely none of ids(doc_id) (or null), and the others, all that match among them."""
    prepare(docs.sparkSession)
    sent = id_filter(ids)
    columns = docs.columns
    if sent is None:
        known = ids.select("doc_id").distinct()
        return tuple(docs.join(known, "doc_id", how).select(*[f"`{c}`" for c in columns]) for how in ("left_anti", "left_semi"))
    h, null = _unused("wc__filter_h", docs), _unused("wc__filter_null", docs)
    hashed = docs.select(*[f"`{c}`" for c in columns], F.xxhash64("doc_id").alias(h), F.col("doc_id").isNull().alias(null))

    def side(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = hits(sent.value, b.column(h)) & ~b.column(null).to_numpy(zero_copy_only=False)
                if (hit == wanted).any():
                    yield b.filter(pa.array(hit == wanted)).select(columns)

        return hashed.mapInArrow(run, docs.schema)

    return side(False), side(True)
