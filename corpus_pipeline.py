"""The corpus pipeline: quality rules, toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. The labels of the toxicity stage are those of sf_dir.

Defined results, of every stage: an empty table gives an empty one; columns of any names come along, those that begin like
the operators' own included; a row without an id is a document of its own; rows that repeat an id and a text are treated
alike. What a stage does with null, empty and very long texts is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellcut.llm import line_dedup, near_dup, packing, quality_rules, toxicity
from wellcut.llm.queries import vocabulary
from wellcut.session import Stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject: null and empty texts too, which have fewer than 50 words."""
    return quality_rules.keep(docs, "v1")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic; none where no toxic label may be learnt from. Null and empty texts have no words."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that occurred before; n_chars, where there is one, follows the text. Null texts stay null, rows without an id as they are."""
    made = line_dedup.keep_first(docs)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Texts without words are near to none and stay; of rows that repeat an id and a text one stays.
    """
    return near_dup.keep(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a null or empty text is the end id alone."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents. Each result but the last is written down; the one before it is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
