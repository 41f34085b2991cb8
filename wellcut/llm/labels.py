"""Bounded samples of labelled and unlabelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: fixes which rows' labels may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows with distinct doc_id, those with the smallest hash of the id: the same at each run."""
    rows = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample with the texts of its documents: one text for each id, the smallest where a table repeats an id.

    ``sample`` holds a documented number of small rows, so it is sent to every task.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in sample.columns if c != "doc_id"])
