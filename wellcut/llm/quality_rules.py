r"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger stores the measurements and one long whose bit i says that
rule i failed. A policy is a named, versioned set of rules: applying it, comparing two policies or asking what a rule
alone rejects needs the ledger only, by bit operations and bitwise aggregation, never the texts again.

Defined results: a null or empty text has no words and measures 0 everywhere (so it fails ``few_words``); lines without
a word never count as repeated; repeated rows give repeated rows; an empty table gives an empty ledger; other columns,
whatever their names, are ignored by ``ledger`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, add_columns, prepare, set_aside, texts, words_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, an SQL expression over the measurements, is true."""

    name: str
    fails: str


#: Bit i of the ledger belongs to RULES[i]; new rules are appended, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("shouting", "n_letters > 0 AND 2 * n_upper > n_letters"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "word_length"),
    "strict-v1": ("few_words", "repeated_words", "symbols", "shouting", "word_length", "repeated_lines"),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more in the text, each word counted once."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text in UTF-8."""
    if not text:
        return (0,) * len(MEASURES)
    words = words_of(text)
    dense = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x and x.translate(None, SPACES)]
    points = len(dense) - len(dense.translate(None, bytes(range(0x80, 0xC0)))) if not dense.isascii() else 0
    return (
        len(words), len(dense) - points, len(dense) - len(dense.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(dense) - len(dense.translate(None, UPPER)), len(dense) - len(dense.translate(None, LETTERS)),
    )


def _bits(prefix: str) -> Column:
    """All rules, each evaluated once, as one long."""
    named = lambda sql: " ".join(f"`{prefix}{x}`" if x in MEASURES else x for x in sql.split(" "))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(named(rule.fails)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def _measured(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    prepare(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> list:
        found = np.array([measure(x) for x in texts(batch)], np.int64).reshape(-1, len(MEASURES))
        return [found[:, i] for i in range(len(MEASURES))]

    return add_columns(docs, [(m, T.LongType()) for m in MEASURES], rows, keep).withColumn(f"{ADDED}failed", _bits(ADDED))


def ledger(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, the MEASURES and ``failed``, the bits of the rules that failed. One narrow pass."""
    made = _measured(docs, ["doc_id", "text"])
    return made.select("doc_id", *[F.col(ADDED + m).alias(m) for m in [*MEASURES, "failed"]])


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept`` by the policy."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their columns; no shuffle."""
    plain, own = set_aside(docs)
    made = _measured(plain, None)
    return own(made.where(F.col(f"{ADDED}failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0))


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    The ledger is aggregated to one row for each combination of failed rules (at most 2 to the number of rules).
    """
    m = mask(policy)
    combos = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1]
    each = combos.withColumn("r", F.explode(F.array(*rules))).select("r.*", "bits", "n")
    left = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(left == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
