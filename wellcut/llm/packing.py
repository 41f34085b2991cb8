r"""Packing by best-fit decreasing.

Documents are encoded, closed by an end id and cut into full windows where they are longer than a window; the remaining
pieces are packed by best-fit decreasing: longest piece first, each into the open window with the least room that still
takes it, found by a segment tree over remaining capacities.

Each task packs blocks of at most ``block_tokens`` ids of its own input split, so there is no shuffle, memory is bounded
by the block, and a lost executor costs its tasks only. A block holds thousands of windows, so that the windows left
partly open at its end add a small fraction of one per cent of padding. Sequence ids are the split's number and a
counter, unique over all splits and the same when a task runs again.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed once each; ties go to
the earlier row; an empty table gives an empty result; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wellcut.llm.byte_bpe import codec
from wellcut.llm.common import prepare, slices, texts

WINDOW = 2048
END_ID = 1
#: Ids that a block holds: 4 M ids are 16 MB and 2048 windows.
BLOCK_TOKENS = 4 << 20
#: Pieces of an Arrow batch that goes out.
BATCH = 512


class Tightest:
    """Segment tree over remaining capacities 0..size: the smallest capacity of at least ``need`` with an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1 - 1).bit_length()
        self.open = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = self.leaves + room
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room that takes ``need``; None if no window does."""
        i = self.leaves + need
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.at[room].pop()
        while i:
            self.open[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset in it for each length (0 < length <= window), and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Tightest(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < window else None
        room, w = found or (window, n)
        n += found is None
        where[i], offset[i] = w, window - room
        if room > need:
            tree.put(room - need, w)
    return where, offset, n


SCHEMA = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32 bits), ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the vocabulary file on every executor.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *SCHEMA.fields])
    names = ["doc_id", *SCHEMA.names]
    end = array("I", [end_id]).tobytes()
    wide = 4 * window

    def flush(block: list[tuple], first: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x[2]) // 4 for x in block], np.int64)
        where, offset, _ = best_fit_decreasing(lengths, window)
        for i in range(0, len(block), BATCH):
            ids, starts, raw, tokens = zip(*block[i : i + BATCH], strict=True)
            cols = [pa.array(ids, kind), pa.array(starts, pa.int64()), pa.array(lengths[i : i + BATCH]), pa.array(raw, pa.binary()), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first + where[i : i + BATCH]), pa.array(offset[i : i + BATCH])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        first = TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        held, kind = 0, pa.int64()
        for b in slices(batches):
            kind = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                raw = c.ids(text) + end
                for i in range(0, len(raw), wide):
                    block.append((doc_id, i // 4, raw[i : i + wide], len(raw) // 4))
                    held += min(wide, len(raw) - i) // 4
                    if held >= block_tokens:
                        yield from flush(block, first, kind)
                        first += len(block)  # more than the windows of the block: ids stay unique
                        block, held = [], 0
        if block:
            yield from flush(block, first, kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
