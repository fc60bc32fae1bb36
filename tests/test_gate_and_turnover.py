"""The sigma gate, and turnover due to a change of covariance."""

from datetime import datetime, timedelta

import numpy as np

import __spark_entry__
from barspan.operators import forecast as I
from barspan.operators import portfolio as H

T = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(4)]


def test_sigma_gate(spark):
    f = spark.createDataFrame([("A", 0.1), ("B", 0.2), ("C", 0.3), ("D", None)], "symbol string, sigma double")
    assert sorted(r.symbol for r in I.sigma_gate(f, 0.2).collect()) == ["A", "B", "D"] and I.sigma_gate(f, None).count() == 4


def test_covariance_turnover_equals_loop(spark):
    rng = np.random.default_rng(5)
    names = {0: "AB", 1: "AB", 2: "ABC", 3: "ABC"}
    cov = {i: np.cov(rng.normal(0, 0.3, (len(n), 40))) for i, n in names.items()}
    mu = {i: rng.normal(0, 0.1, len(n)) for i, n in names.items()}
    prev = {i: rng.normal(0, 0.1, len(n)) for i, n in names.items()}
    c = spark.createDataFrame([(T[i], a, b, float(cov[i][x, y])) for i, n in names.items() for x, a in enumerate(n) for y, b in enumerate(n)], "bar_ts timestamp_ntz, sym_i string, sym_j string, cov double")
    m = spark.createDataFrame([("s", T[i], a, float(mu[i][x])) for i, n in names.items() for x, a in enumerate(n)], "strategy_id string, bar_ts timestamp_ntz, symbol string, mu double")
    w = spark.createDataFrame([("s", T[i], a, float(prev[i][x])) for i, n in names.items() for x, a in enumerate(n)], H.WEIGHTS)
    got = {r.bar_ts: r.turnover_sigma for r in H.covariance_turnover(m, c, w).collect()}
    solve = lambda i, s: np.linalg.solve(5 * s + 0.2 * 1.0005 * np.eye(len(s)), mu[i] + 0.2 * 1.0005 * prev[i])
    want = {i: float(np.abs(solve(i, cov[i]) - solve(i, cov[i - 1])).sum()) for i in (1, 3)}
    assert got[T[0]] is None and got[T[2]] is None
    assert np.isclose(got[T[1]], want[1]) and np.isclose(got[T[3]], want[3])


def test_registered():
    assert {"c06_sigma_gate", "h11_covariance_turnover"} <= set(__spark_entry__.queries())
