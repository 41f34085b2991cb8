import math

import pytest
from pyspark.sql import functions as F

from wellcut.functions.criterion import LOG, POWER, SIMPLE, Criterion


@pytest.mark.parametrize(
    ("text", "kind", "c", "x"),
    [("1log_10(n)", LOG, 1, 10), ("log_2(n)", LOG, 1, 2), ("2log_10(n)", LOG, 2, 10), ("2n^0.5", POWER, 2, 0.5), ("n^1", POWER, 1, 1), ("1", LOG, 1, 10)],
)
def test_parse(text, kind, c, x):
    assert Criterion.parse(text) == Criterion(kind, c, x)


def test_parse_simple_and_errors():
    assert Criterion.parse("0").kind == SIMPLE
    for bad in ("abc", "", "xlog_10(n)", "2n^y"):
        with pytest.raises(ValueError):
            Criterion.parse(bad)


def test_required_cut():
    c = Criterion.parse("1log_10(n)")
    want = {2: 1, 9: 1, 10: 1, 11: 2, 99: 2, 100: 2, 101: 3, 1000: 3, 1001: 4, 10000: 4}
    assert {n: c.required_cut(n) for n in want} == want
    assert not Criterion.parse("0").holds(5, 99)


def test_column_agrees_with_python(spark):
    for text in ("1log_10(n)", "2log_10(n)", "log_2(n)", "1n^0.5", "0"):
        c = Criterion.parse(text)
        rows = spark.range(1, 1001).select(F.col("id").alias("n"), (F.col("id") % 5).alias("cut"))
        for r in rows.select("n", "cut", c.column("n", "cut").alias("ok")).collect():
            assert r["ok"] == c.holds(r["n"], r["cut"]), (text, r)
        assert c.kind == SIMPLE or all(c.holds(n, c.required_cut(n)) and not c.holds(n, c.required_cut(n) - 1) for n in range(1, 300))


def test_power_of_one_never_holds_on_simple_graphs():
    c = Criterion.parse("1n^1")
    assert not any(c.holds(n, n - 1) for n in range(2, 50))
    assert math.isinf(Criterion.parse("0").required_cut(3))
