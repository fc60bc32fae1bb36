"""Expanding z-scores against a loop, the scaled features, first covariances, defaults, monitors and standardisers on literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.operators import features as E
from barspan.operators import forecast as I
from barspan.operators import grid as G
from barspan.operators import monitor as L
from barspan.operators import risk as V
from barspan.operators import scan
from barspan.schema import FEATURES
from barspan.sources import readers as A


def winsor_loop(x, warmup):
    out, held = np.full(len(x), np.nan), []
    for i, v in enumerate(x):
        if not np.isfinite(v):
            continue
        held.append(v)
        if len(held) < warmup:
            continue
        cuts = np.percentile(held, [1, 99])
        c = np.clip(held, *cuts)
        out[i] = (np.clip(v, *cuts) - c.mean()) / (c.std() or 1.0)
    return out


@pytest.mark.parametrize("warmup", [1, 2, 5, 200])
def test_z_scores_equal_a_loop(warmup):
    rng = np.random.default_rng(warmup)
    for x in (rng.normal(size=500), np.round(rng.normal(size=500)), 1e4 + rng.normal(size=500), np.sort(rng.normal(size=500)), np.full(300, 7.25)):
        x[rng.random(len(x)) < 0.1] = np.nan
        assert np.allclose(E.winsor_z_values(x, warmup), winsor_loop(x, warmup), rtol=1e-9, atol=1e-9, equal_nan=True)
    assert np.isnan(E.winsor_z_values(np.full(5, np.nan), 1)).all() and len(E.winsor_z_values(np.empty(0))) == 0


def test_scaled_features_are_all_but_return_and_volume(spark):
    rng = np.random.default_rng(1)
    close = np.exp(np.cumsum(rng.normal(size=80) * 0.01)).tolist()
    rows = [("A", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", c, c * 1.01, c * 0.99, c, float(10 + i)) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume double").withColumn("bar_ts", F.col("t").cast("timestamp_ntz")).drop("t")
    funding = bars.select("symbol", F.col("bar_ts").alias("ts"), (F.col("volume") % 7).alias("rate"))
    raw = E.raw_features(bars, funding).orderBy("bar_ts").toPandas()
    got = E.feature_frame(bars, funding, warmup=10).orderBy("bar_ts").toPandas()
    for c in FEATURES:
        x = raw[c].to_numpy(float)
        want = x if c in ("log_return", "log_volume") else winsor_loop(x, 10)
        assert np.allclose(got[c].to_numpy(float), want, atol=1e-9, equal_nan=True), c


def test_scan_over_blocks_and_missing_rows(spark):
    rng = np.random.default_rng(2)
    x = [None if i % 7 == 3 else float(v) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)] + [("B", 0, None)], "symbol string, bar_ts long, b double")
    got = {(r.symbol, r.bar_ts): r.s for r in scan.affine_scan(df, "b", 0.5, "s").collect()}
    s = 0.0
    for i, v in enumerate(x):
        if v is None:
            assert got["A", i] is None
        else:
            s = 0.5 * s + v
            assert got["A", i] == pytest.approx(s, abs=1e-12)
    assert got["B", 0] is None


def test_first_covariance_has_the_chosen_variance(spark):
    rows = [("A", 1, 0.1, 0.04), ("B", 1, 0.2, 0.03), ("A", 2, 0.3, 0.05), ("B", 2, 0.1, 0.05)]
    t = spark.createDataFrame(rows, "symbol string, bar_ts long, ret double, var double")
    got = {(r.bar_ts, r.sym_i, r.sym_j): r.cov for r in V.rolling_covariance(t).collect()}
    assert got[1, "A", "A"] == 0.04 and got[1, "B", "B"] == 0.03 and got[1, "A", "B"] == 0.0
    assert got[2, "A", "A"] == pytest.approx(0.02) and got[2, "A", "B"] == pytest.approx(-0.01)
    assert [r.ready for r in V.model_ready(V.rolling_covariance(t), 2).orderBy("bar_ts").collect()] == [False, True]


def test_defaults_and_membership(spark):
    symbols = spark.createDataFrame([("btcusdt",), ("DOGEUSDT",), (None,)], "symbol string")
    got = {r.symbol: (r.step_size, r.min_qty, r.min_notional) for r in A.default_symbol_filters(symbols, 6.0).collect()}
    assert got == {"btcusdt": (0.0001, 0.001, 6.0), "DOGEUSDT": (0.0, 0.0, 6.0), None: (0.0, 0.0, 6.0)}
    rows = spark.createDataFrame([("BTC/USDT", 1), ("ETHUSDT", 2), (None, 3)], "symbol string, _symbol int")
    assert [tuple(r) for r in G.in_universe(rows, symbols).collect()] == [("BTC/USDT", 1)]


def test_monitors_leave_out_what_is_missing(spark):
    df = spark.sql("select 1 as bar_ts, map('A', named_struct('rolling_msep', 1d), 'B', named_struct('rolling_msep', double('nan')), 'C', named_struct('rolling_msep', 3d)) as forecast_monitor union all select 2, map()")
    assert {r.bar_ts: r.avg_rolling_msep for r in L.mean_rolling_error(df).collect()} == {1: 2.0, 2: None}
    slow = spark.createDataFrame([(1, 500.0), (2, 500.1), (3, None)], "k int, latency_ms double")
    assert [r.k for r in L.slow_forecasts(slow).collect()] == [2]


def test_standardizer_goes_to_json_and_back(spark):
    rows = [("A", 0, f, 0.5 * f, 1.0 + f) for f in (-1, 0, 1, 2)] + [("B", 3, -1, 1.0, 2.0), ("B", 3, 0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, fold int, feature int, mean double, std double")
    assert sorted(map(tuple, I.standardizer_from_json(I.standardizer_to_json(df)).collect())) == sorted(rows)
