"""Scans over chunks of a symbol against those over the whole symbol."""

import datetime as dt
import math
import random

import pytest

from barspan.operators import divided as D
from barspan.operators import features as E
from barspan.operators import risk as V
from barspan.operators.returns import with_returns
from pyspark.sql import functions as F

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, n=900, seed=1):
    """One busy symbol with missing closes, flat stretches and gaps over many chunks, and two short ones."""
    rnd, rows, t0 = random.Random(seed), [], dt.datetime(2024, 1, 1)
    for symbol, count in (("HOT", n), ("FEW", 9), ("ONE", 1)):
        p, t = 100.0, t0
        for i in range(count):
            p = p if i % 50 > 30 else max(1.0, p * math.exp(rnd.gauss(0, 0.03)))
            close = None if symbol == "HOT" and i % 37 == 5 else p
            rows.append((symbol, t, p, p * 1.01, p * 0.98, close, rnd.random()))
            t += dt.timedelta(hours=1 if rnd.random() < 0.97 else 200)
    return spark.createDataFrame(rows, BARS).repartition(5)


def alike(a, b, column):
    a, b = ({(r["symbol"], r["bar_ts"]): r[column] for r in x.collect()} for x in (a, b))
    assert set(a) == set(b) and sum(v is not None for v in b.values()) > 0
    for k, v in b.items():
        assert (a[k] is None) == (v is None), (k, a[k], v)
        assert v is None or abs(a[k] - v) <= 1e-9 * max(1e-3, abs(v)) + 1e-12, (k, a[k], v)


@pytest.mark.parametrize("span", ["12h", "20d"])
def test_features_by_chunks(spark, span):
    df = bars(spark)
    alike(D.rsi_innovation(df, span), E.with_rsi_innovation(df), "rsi_innov")
    alike(D.atr_innovation(df, span), E.with_atr_innovation(df), "atr_innov")


def test_variances_by_chunks(spark):
    returns = with_returns(bars(spark)).select("symbol", "bar_ts", "ret")
    alike(D.ewma_variance(returns, "2d"), V.ewma_variance(returns), "ewma_var")
    alike(D.garch_variance(returns, "2d", size=64), V.garch_variance(returns), "garch_var")


def test_one_symbol_uses_many_tasks(spark):
    """No task of the second pass holds more than a chunk of the only symbol."""
    df = bars(spark).filter("symbol = 'HOT'")
    cut = D.lagged(D.chunks(df, "5d"), {"prev": "close"})
    assert cut.select("_chunk").distinct().count() > 8
    held = cut.withColumn("p", F.spark_partition_id()).groupBy("p").count().count()
    assert held > 1 and cut.filter("bar_no = 1").count() == 1 and cut.agg(F.max("bar_no")).first()[0] == 900


def test_nothing_in_chunks(spark):
    none = spark.createDataFrame([], BARS)
    assert D.rsi_innovation(none, "1d").count() == 0
    with pytest.raises(ValueError):
        D.numbered_parts(none, "close", 3, 5)


@pytest.mark.parametrize("size", [16, 100])
def test_scores_by_parts(spark, size):
    """Continuous values, many ties, a level far from 0, values that come in order, and missing ones."""
    import numpy as np

    from barspan.operators.divided_scores import winsor_scores
    from barspan.operators.features import winsor_z_values

    rng, t0, n = np.random.default_rng(3), dt.datetime(2024, 1, 1), 700
    series = {"free": rng.normal(size=n), "tied": rng.choice([0.0, 0.0, 0.0, 1.0, -2.0], n), "far": 1e6 + rng.normal(size=n) / 10, "rising": np.arange(n) * 1.0, "holes": np.where(rng.random(n) < 0.3, np.nan, rng.standard_cauchy(n))}
    rows = [("A", t0 + i * dt.timedelta(hours=1), *[float(v[i]) for v in series.values()]) for i in range(n)] + [("B", t0, 1.0, 2.0, 3.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, " + ", ".join(f"{c} double" for c in series)).repartition(3)
    for warmup in (1, 200):
        got = {(r["feature"], r["bar_ts"]): r["z"] for r in winsor_scores(df, list(series), "4d", size, warmup).filter("symbol = 'A'").collect()}
        for name, x in series.items():
            for i, z in enumerate(winsor_z_values(x, warmup)):
                found = got.get((name, t0 + i * dt.timedelta(hours=1)))
                assert (found is None) == bool(np.isnan(z)), (name, i, found, z)
                assert found is None or abs(found - z) < 1e-9 * max(1.0, abs(z)) + 1e-8 * (name == "far"), (name, i, found, z)


def test_scores_of_nothing(spark):
    from barspan.operators.divided_scores import winsor_scores

    assert winsor_scores(spark.createDataFrame([], BARS), ["close"], "1d").count() == 0
