r"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is one run of fixed-width little-endian ids in which an end-of-document id closes each document; nothing
says where documents begin. The files are cut into blocks that ignore document boundaries; tasks read their blocks as byte
ranges, so a file may be of any size. Each block is searched for the separator in one vectorised comparison and reduced to
its number of ids and the positions found. A prefix scan over the blocks of a file, within runs of RUN blocks and then over
the runs, tells each block how many documents ended before it and where the last one ended, which is all that is needed to
stitch the documents that cross blocks.

Only positions are shuffled, eight bytes for each document; the ids never are.

``token_counts`` makes such files of a table of documents in the shared folder, one for each input split, with a table that
says which document is the how manieth of which file, scans them and deletes them. It does so in ``passes`` over the table,
by a hash of the ids, so that the files of one pass at a time take disk.

Defined results: an empty document counts 0; ids after the last separator are a document with ``closed`` false; a file
without ids has no documents; an id torn by the end of a file isn't counted; repeated rows are separate documents; an id
that the file's width doesn't hold is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.byte_bpe import codec
from wellcut.llm.common import prepare, slices, texts
from wellcut.session import Stored, delete, shared_dir

BLOCK_BYTES = 4 << 20
#: Blocks of a file whose prefix sums one task makes.
RUN = 1024
#: Bytes that are gathered before they are written.
FLUSH = 4 << 20
FOUND = T.StructType([T.StructField("file", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("block", "n_at", "last_at", "end")], T.StructField("at", T.BinaryType())])


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, dtype: str = "<u2") -> DataFrame:
    """Writes the ids of docs(doc_id, text) to flat files under ``folder``, one for each input split that has rows.

    Returns (file, document, doc_id), to be evaluated once. A task writes under a name of its own and renames the file
    when it is whole, so a task that runs again leaves the same file.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("document", T.LongType()), docs.schema["doc_id"]])
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, most = codec(path), np.iinfo(dtype).max
        store, root = fs.FileSystem.from_uri(folder)
        name, own = f"part-{TaskContext.get().partitionId():06d}.bin", f"{root}/_{uuid.uuid4().hex}"
        out, held, n = None, bytearray(), 0
        for b in slices(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own)
            for text in texts(b):
                ids = np.frombuffer(c.ids(text, special=False), "<u4")
                if len(ids) and ids.max() > most:
                    raise ValueError(f"id {ids.max()} is too large for {dtype}")
                held += ids.astype(dtype).tobytes() + end
                if len(held) >= FLUSH:
                    out.write(bytes(held))
                    held.clear()
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(range(n, n + rows), pa.int64()), b.column("doc_id")], names=schema.names)
            n += rows
        if out is not None:
            out.write(bytes(held))
            out.close()
            store.move(own, f"{root}/{name}")

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def files_of(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files in a folder, or of one file, by Spark's own file systems."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    path = store.resolvePath(path)  # where a mounted path leads
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))


def search(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """FOUND of each block of the token files: separators, the last one's place and the block's end, in the file; all places."""
    width = np.dtype(dtype).itemsize
    step = max(1, block_bytes // width)
    files = [(path, size // width) for path, size in files_of(spark, folder)]
    rows = spark.createDataFrame(files, "path string, n long").where("n > 0")
    rows = rows.select("path", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))).alias("block")).repartition("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, name = fs.FileSystem.from_uri(r["path"])
                begin = r["block"] * step
                stop = min(r["n"], begin + step)
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at((stop - begin) * width, begin * width), dtype)
                at = np.flatnonzero(ids == end_id) + begin
                cols = [[name.rsplit("/", 1)[-1]], [r["block"]], [len(at)], [int(at[-1]) if len(at) else None], [stop], [at.astype("<i8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=FOUND.names)

    return rows.mapInArrow(run, FOUND)


def stitch(found: DataFrame) -> DataFrame:
    """FOUND of blocks: file, document (0, 1, ... in the file), n_tokens without the separator, closed."""
    rows = found.withColumn("run", F.floor(F.col("block") / RUN))
    runs = rows.groupBy("file", "run").agg(F.sum("n_at").alias("n"), F.max("last_at").alias("last"))
    earlier = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_run"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last_run"), F.lead("run").over(W.partitionBy("file").orderBy("run")).isNull().alias("final_run"))
    inside = W.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n_in", F.coalesce(F.sum("n_at").over(before), F.lit(0))).withColumn("last_in", F.max("last_at").over(before)).withColumn("final_in", F.lead("block").over(inside).isNull())
    rows = rows.join(runs, ["file", "run"]).select("file", "at", "end", (F.col("n_run") + F.col("n_in")).alias("first"), F.coalesce("last_in", "last_run").alias("last"), (F.col("final_run") & F.col("final_in")).alias("final"))
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("document", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("closed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends = np.frombuffer(r["at"], "<i8")
                size = np.diff(ends, prepend=r["last"]) - 1
                left = r["end"] - 1 - (int(ends[-1]) if len(ends) else r["last"])
                closed = np.ones(len(size), bool)
                if r["final"] and left > 0:
                    size, closed = np.append(size, left), np.append(closed, False)
                if len(size):
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(size), pa.string()), pa.array(r["first"] + np.arange(len(size))), pa.array(size), pa.array(closed)], names=out.names)

    return rows.mapInArrow(run, out)


def scan(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents of the token files under a folder: file, document, n_tokens, closed."""
    return stitch(Stored(search(spark, folder, end_id, dtype, block_bytes), "separators").df)


def token_counts(docs: DataFrame, path: str, end_id: int = 50256, passes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, document and n_tokens of the documents, counted in their flat token files."""
    made = []
    for k in range(passes):
        folder = f"{shared_dir(docs.sparkSession)}/wellcut/tokens-{uuid.uuid4().hex}"
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == k)
        named = Stored(write_files(part, path, end_id, folder), "named").df
        if named.isEmpty():
            made.append(named.withColumn("n_tokens", F.lit(0).cast("long")))
            continue
        counted = scan(docs.sparkSession, folder, end_id, block_bytes=block_bytes)
        delete(docs.sparkSession, folder)
        made.append(named.join(counted.select("file", "document", "n_tokens"), ["file", "document"]))
    return reduce(DataFrame.unionByName, made).select("doc_id", "file", "document", "n_tokens")
