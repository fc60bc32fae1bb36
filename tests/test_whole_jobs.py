"""Portfolio and risk queries over all symbols and bars, against plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barspan.operators import portfolio as H
from barspan.operators import risk as V
from barspan.plans import portfolio_plans as P

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def market(spark):
    """Returns by bar and symbol, and their covariances over 250 common bars, by a loop."""
    got = P.rets(spark, SF).filter("ret is not null").select("bar_ts", "symbol", "ret").toPandas()
    r = got.pivot(index="bar_ts", columns="symbol", values="ret").sort_index()
    names, values = list(r.columns), r.to_numpy()

    def cov(i, j, at):
        both = values[: at + 1][np.isfinite(values[: at + 1, i]) & np.isfinite(values[: at + 1, j])][-250:]
        if len(both) == 1:
            return both[0, i] ** 2 if i == j else 0.0
        return float(np.cov(both[:, i], both[:, j])[0, 1])

    def matrix(at):
        here = [i for i in range(len(names)) if np.isfinite(values[at, i])]
        return [names[i] for i in here], values[at, here], np.array([[cov(i, j, at) for j in here] for i in here])

    return list(r.index), matrix


def sampled(n):
    return [0, 1, 2, 30, 100, *range(200, n, max(1, n // 25)), n - 1]


def test_mean_variance_full_equals_loop(spark, market):
    bars, matrix = market
    out = __spark_entry__.queries()["h01_mean_variance_full"](spark, SF).toPandas()
    mu = {(x.strategy_id, x.bar_ts, x.symbol): x.mu for x in P._mu(spark, SF).collect()}
    prev = {(x.strategy_id, x.bar_ts, x.symbol): x.weight for x in H.lagged_weights(P.weights(spark, SF)).collect()}
    assert len(out) == len(mu) and set(out["bar_ts"]) == set(bars)
    off, pulled, got = 0, 0, {(x.strategy_id, x.bar_ts, x.symbol): x.weight for x in out.itertuples()}
    for at in sampled(len(bars)):
        names, _, c = matrix(at)
        for sid in ("mom3", "mom15"):
            m = np.array([mu[sid, bars[at], x] or 0.0 for x in names])
            before = [prev.get((sid, bars[at], x)) for x in names]
            k, lam = np.ones(len(names)), 0.1
            if any(x is not None for x in before):
                k = k * (1 + 5 / 1e4)
                m, pulled = m + 2 * lam * k * np.array([x or 0.0 for x in before]), pulled + 1
            want = np.linalg.solve(5.0 * c + 2 * lam * np.diag(k), m)
            assert np.allclose([got[sid, bars[at], x] for x in names], want, rtol=1e-6, atol=1e-9)
            off += int(np.abs(c - np.diag(np.diag(c))).max() > 0)
    assert off > 20 and pulled > 20


def test_mahalanobis_of_all_symbols_equals_loop(spark, market):
    bars, matrix = market
    out = __spark_entry__.queries()["g09_mahalanobis"](spark, SF).orderBy("bar_ts").toPandas()
    assert list(out["bar_ts"]) == bars and out["n"].max() > 2 and out["d2"].notna().all()
    for at in sampled(len(bars)):
        names, x, c = matrix(at)
        if np.linalg.matrix_rank(c) < len(names) or np.linalg.cond(c) > 1e10:
            continue  # what a pseudo-inverse drops there hangs on the last digits
        assert out["n"][at] == len(names) and np.isclose(out["d2"][at], x @ np.linalg.inv(c) @ x, rtol=1e-6)
    want = (out["d2"] - out["n"]).rolling(200, min_periods=1).mean()
    assert np.allclose(out["malv"], want, rtol=1e-6, atol=1e-8)


def test_mahalanobis_closed_form_of_two(spark):
    t = [T0 + timedelta(days=i) for i in range(1)]
    c = spark.createDataFrame([(t[0], "A", "A", 0.04), (t[0], "A", "B", 0.01), (t[0], "B", "B", 0.09)], "bar_ts timestamp_ntz, sym_i string, sym_j string, cov double")
    r = spark.createDataFrame([(t[0], "A", 0.1), (t[0], "B", -0.2)], "bar_ts timestamp_ntz, symbol string, ret double")
    got = V.malv(V.mahalanobis(c, r)).first()
    d2 = (0.09 * 0.01 + 2 * 0.01 * 0.02 + 0.04 * 0.04) / (0.04 * 0.09 - 0.0001)
    assert got.n == 2 and np.isclose(got.d2, d2) and np.isclose(got.malv, d2 - 2)


def test_read_bars_returns_every_symbol(spark):
    got = __spark_entry__.queries()["a01_read_bars_all"](spark, SF)
    assert got.select("symbol").distinct().count() == P.rets(spark, SF).select("symbol").distinct().count() > 1
    assert got.count() == P.rets(spark, SF).filter(F.col("close").isNotNull()).count()
