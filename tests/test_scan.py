"""The recurrence with changing coefficients against a loop."""

import random

import pytest

from barspan.operators.scan import varying_scan
from pyspark.sql import functions as F


def by_loop(rows):
    out, last = {}, {}
    for k, n, a, b in sorted(rows, key=lambda r: (r[0], r[1])):
        s = (1.0 if a is None else a) * last.get(k, 0.0) + (0.0 if b is None else b)
        out[k, n] = last[k] = s
    return out


@pytest.mark.parametrize("kind", ["mixed", "falls fast", "keeps", "jumps", "no start"])
def test_varying_scan(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "mixed": lambda: rnd.choice([0.0, 1.0, rnd.random(), None]), "falls fast": lambda: rnd.choice([0.5, 0.01]), "keeps": lambda: 1 - rnd.random() / 1e4,
        "jumps": lambda: rnd.choice([1e-300, 1e-120, 0.9, 1.0]), "no start": lambda: 0.999,
    }[kind]
    rows = [(k, n, draw(), rnd.choice([None, 0.0, rnd.random() * 100])) for k in "ab" for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, a double, b double").repartition(5)
    want = by_loop(rows)
    for r in varying_scan(df, F.col("a"), F.col("b"), "s", ["k"], ["n"]).collect():
        assert abs(r["s"] - want[r["k"], r["n"]]) <= 1e-9 * max(1.0, abs(want[r["k"], r["n"]])), (kind, r)


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], "k string, n int, a double, b double")
    assert varying_scan(none, F.col("a"), F.col("b"), "s", ["k"], ["n"]).columns == ["k", "n", "a", "b", "s"]
    assert varying_scan(none, F.col("a"), F.col("b"), "s", ["k"], ["n"]).count() == 0
