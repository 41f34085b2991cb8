"""Connectedness criteria: ``Clog_x(n)``, ``Cn^x`` or ``0``.

A cluster of n nodes is well connected where f(n) < cut, with f(n) = (C / ln x) * ln n or C * n^x. The logarithm is
evaluated in doubles exactly in that order of operations, which matters at powers of x: (1 / ln 10) * ln 10 is a little
below 1, so a cut of 1 is enough for 10 nodes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE, LOG, POWER = "simple", "log", "power"
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _leading_number(text: str, what: str) -> float:
    """The number a text starts with; what follows it is ignored."""
    m = re.match(rf"\s*({_NUMBER})", text)
    if not m:
        raise ValueError(f"{what} isn't a number: {text!r}")
    return float(m[1])


@dataclass(frozen=True)
class Criterion:
    kind: str
    c: float = 0.0
    x: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Criterion:
        """``log_`` wins over ``n^``; an empty C is 1; ``1`` is short for ``1log_10(n)``."""
        if text == "1":
            text = "1log_10(n)"
        for mark, kind in (("log_", LOG), ("n^", POWER)):
            head, found, tail = text.partition(mark)
            if found:
                return cls(kind, _leading_number(head, "C") if head else 1.0, _leading_number(tail, "x"))
        if text == "0":
            return cls(SIMPLE)
        raise ValueError(f"unknown criterion: {text!r}")

    @property
    def pre(self) -> float:
        return self.c / math.log(self.x)

    def bound(self, n: int) -> float:
        """f(n)."""
        if self.kind == LOG:
            return self.pre * math.log(n)
        if self.kind == POWER:
            return self.c * math.pow(n, self.x)
        return math.inf

    def holds(self, n: int, cut: int) -> bool:
        return self.bound(n) < cut

    def required_cut(self, n: int) -> float:
        """The smallest cut that passes for n nodes."""
        f = self.bound(n)
        return math.floor(f) + 1 if math.isfinite(f) else math.inf

    def column(self, n: Column | str, cut: Column | str) -> Column:
        """The same test over columns; the constant part is folded here."""
        n, cut = (F.col(v) if isinstance(v, str) else v for v in (n, cut))
        if self.kind == LOG:
            return F.lit(self.pre) * F.log(n.cast("double")) < cut
        if self.kind == POWER:
            return F.lit(self.c) * F.pow(n.cast("double"), F.lit(self.x)) < cut
        return F.lit(False)


def connected(cut: Column | str) -> Column:
    """Whether a graph with this minimum cut is connected."""
    return (F.col(cut) if isinstance(cut, str) else cut) >= 1
