"""Log lines and telemetry rows."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of the command line: 0 silent, 1 info, 2 verbose.
LEVELS = {0: logging.CRITICAL, 1: logging.INFO, 2: logging.DEBUG}
SCHEMA = "stage string, iteration long, op string, wall_s double, bytes long"


def split_duration(seconds: int) -> tuple[int, int, int, int]:
    """Days, hours, minutes and seconds."""
    m, s = divmod(seconds, 60)
    h, m = divmod(m, 60)
    d, h = divmod(h, 24)
    return d, h, m, s


class Elapsed(logging.Formatter):
    """``[INFO][d-h:m:s](t=Ns) message``, counted from the formatter's start; of a stage, its name and milliseconds."""

    def __init__(self, stage: str | None = None) -> None:
        super().__init__()
        self.began, self.stage = time.time(), stage

    def format(self, record: logging.LogRecord) -> str:
        t = record.created - self.began
        d, h, m, s = split_duration(int(t))
        if self.stage is None:
            return f"[{record.levelname}][{d}-{h}:{m}:{s}](t={int(t)}s) {record.getMessage()}"
        return f"[{record.levelname}][{d}-{h}:{m}:{s}](t={int(1000 * t)}ms) {self.stage}: {record.getMessage()}"


def logger(path: str | None, level: int = 1, stage: str | None = None) -> logging.Logger:
    out = logging.getLogger(f"wellcut.run.{path}.{stage}")
    out.handlers.clear()
    out.propagate = False
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(Elapsed(stage))
    out.addHandler(handler)
    out.setLevel(LEVELS.get(level, logging.INFO))
    return out


@dataclass
class Recorder:
    """Gathers a row for each step of a run."""

    rows: list[dict] = field(default_factory=list)

    @contextmanager
    def step(self, stage: str, op: str, iteration: int = 0) -> Iterator[dict]:
        row = {"stage": stage, "iteration": iteration, "op": op, "wall_s": 0.0, "bytes": 0}
        began = time.perf_counter()
        try:
            yield row
        finally:
            row["wall_s"] = time.perf_counter() - began
            self.rows.append(row)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["stage"], r["iteration"], r["op"], float(r["wall_s"]), int(r["bytes"])) for r in self.rows], SCHEMA)


def totals(rows: DataFrame) -> DataFrame:
    """Time and bytes by operation, and the most steps of it in one stage."""
    per = rows.groupBy("op", "stage").agg(F.count("*").alias("n"), F.sum("wall_s").alias("w"), F.sum("bytes").alias("b"))
    return per.groupBy("op").agg(F.sum("w").alias("wall_s"), F.sum("b").alias("bytes"), F.max("n").alias("most_steps"))
