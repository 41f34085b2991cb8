"""What the operators on texts share: bounded Arrow batches, columns carried along, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; texts of a batch are worked on in slices of about SLICE_BYTES.
ARROW_ROWS = 256
SLICE_BYTES = 4 << 20
#: Prefix of the columns that operators add beside the columns of their input.
ADDED = "wc__"


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def words_of(text: bytes | None) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+: bytes.split() cuts at exactly these six ASCII characters."""
    return text.split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(name).nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def set_aside(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with other names for columns that begin like added ones, and what selects its own columns by their own names again."""
    names = {c: f"held{i}__{c}" if c.lower().startswith(ADDED) else c for i, c in enumerate(df.columns)}
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return plain, lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def add_columns(df: DataFrame, added: list[tuple[str, T.DataType]], fn: Callable, keep: list[str] | None = None) -> DataFrame:
    """df with columns that fn makes of each slice: fn(batch) returns the arrays of the columns ``added``.

    The columns ``keep`` (all where None) come along untouched, whatever their names; the added ones are named with
    the prefix ADDED so that they can't clash.
    """
    df = df if keep is None else df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*df.schema.fields, *[T.StructField(ADDED + n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [a if isinstance(a, pa.Array) else pa.array(a) for a in fn(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[ADDED + n for n, _ in added]])

    return df.mapInArrow(run, schema)
