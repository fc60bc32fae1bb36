"""Bar and portfolio operators on small literal tables and against plain loops."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.functions import scalars as S
from barspan.operators import features as E
from barspan.operators import grid as G
from barspan.operators import ledger as J
from barspan.operators import performance as K
from barspan.operators import portfolio as H
from barspan.operators import returns as R
from barspan.operators import risk as V
from barspan.operators import scan

T0 = datetime(2024, 1, 1)
BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def ramp(n=20, symbol="A", step=8):
    close = np.linspace(100, 110, n)
    volume = np.linspace(1000, 2000, n)
    return [(symbol, T0 + timedelta(hours=step * i), float(c), float(c * 1.001), float(c * 0.999), float(c), float(v)) for i, (c, v) in enumerate(zip(close, volume, strict=True))]


def walk(n, seed=0, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(symbol, T0 + timedelta(hours=8 * i), float(c), float(c * (1 + abs(rng.normal(0, 0.01)))), float(c * (1 - abs(rng.normal(0, 0.01)))), float(c), float(rng.uniform(1, 9))) for i, c in enumerate(close)]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(900, 1, "A") + walk(700, 2, "B"), BARS).repartition(3)


def column(df, name, symbol="A", ts="bar_ts"):
    return [r[name] for r in df.filter(F.col("symbol") == symbol).orderBy(ts).collect()]


def test_timeframes():
    assert [S.timeframe_ms(t) for t in ("5m", "8h", "1d", "2w")] == [300_000, 28_800_000, 86_400_000, 1_209_600_000]
    assert S.bars_per_day("8h") == 3 and S.bars_per_day("1w") == 1
    for bad in ("8x", "h", "", "0h"):
        with pytest.raises(ValueError):
            S.timeframe_ms(bad)


def test_grid_gaps_order_and_duplicates(spark):
    ms = [0, 600_000, 600_000, 300_001, 123_456]
    a = spark.createDataFrame([("A", i, x, float(i)) for i, x in enumerate(ms)], "symbol string, arrival_seq long, ms long, px double").withColumn("bar_ts", S.from_millis(F.col("ms")))
    first = G.first_per_step(a, "5m")
    assert sorted((r.bar_ts.minute, r.px) for r in first.collect()) == [(0, 0.0), (5, 3.0), (10, 1.0)]
    assert [r.px for r in G.drop_out_of_order(a).orderBy("arrival_seq").collect()] == [0.0, 1.0]
    gap = spark.createDataFrame([("A", T0), ("A", T0 + timedelta(minutes=20))], "symbol string, bar_ts timestamp_ntz")
    assert [r.bar_ts.minute for r in G.missing_bars(gap, "5m").orderBy("bar_ts").collect()] == [5, 10, 15]
    assert G.missing_bars(gap.limit(0), "5m").count() == 0


def test_closed_bars_and_locf(spark):
    b = spark.createDataFrame(ramp(3, step=1) + [("B", T0 + timedelta(hours=1), 1.0, 1.0, 1.0, 5.0, 1.0)], BARS)
    assert G.closed_bars(b.filter("symbol = 'A'"), "2024-01-01 02:30:00", "1h").count() == 2
    got = {(r.symbol, r.bar_ts.hour): r.close for r in G.locf(b, G.clock(b)).collect()}
    assert got["B", 2] == 5.0 and ("B", 0) not in got and len(got) == 5


def test_scan_equals_loop(bars):
    x = column(bars, "close")
    for span in (3, 20):
        got = column(scan.ema(bars, "close", span, "e"), "e")
        want = pd.Series(x).ewm(span=span, adjust=False).mean()
        assert np.allclose(got, want, rtol=1e-11)
    got = column(scan.wilder(bars, "close", 14, "w"), "w")
    want = [None] * 13 + [float(np.mean(x[:14]))]
    for v in x[14:]:
        want.append(want[-1] + (v - want[-1]) / 14)
    assert got[:13] == [None] * 13 and np.allclose(got[13:], want[13:], rtol=1e-11)


def test_rsi_rules(spark):
    up = E.with_rsi(spark.createDataFrame(ramp(20), BARS))
    assert column(up, "rsi")[:12] == [None] * 12 and set(column(up, "rsi")[12:]) == {100.0}
    flat = spark.createDataFrame([(s, t, 1.0, 1.0, 1.0, 1.0, v) for s, t, *_, v in ramp(20)], BARS)
    assert set(column(E.with_rsi(flat), "rsi")[12:]) == {50.0}


def test_winsor_z_equals_numpy(bars):
    x = np.array(column(bars, "volume"))
    got = column(E.winsor_z(bars.select("symbol", "bar_ts", "volume"), ["volume"]), "volume_z")
    native = column(bars.filter("symbol = 'A'").select("symbol", "bar_ts", E.winsor_z_native("volume").alias("z")).filter("bar_ts < timestamp_ntz'2024-03-20'"), "z")
    for i in (198, 199, 230, 899):
        if i < 199:
            assert got[i] is None
            continue
        h = x[: i + 1]
        lo, hi = np.quantile(h, 0.01), np.quantile(h, 0.99)
        c = np.clip(h, lo, hi)
        want = (np.clip(x[i], lo, hi) - c.mean()) / c.std()
        assert abs(got[i] - want) < 1e-10
        if i < len(native):
            assert abs(native[i] - want) < 1e-9


def test_momentum_obv_windows_and_sequences(bars):
    t = R.with_returns(bars)
    r = [x for x in column(t, "log_ret")]
    got = column(t.withColumn("m", E.tsmom("log_ret", 3)), "m")
    assert got[0] is None and abs(got[9] - sum(r[7:10]) / math.sqrt(sum(x * x for x in r[7:10]))) < 1e-12
    f = t.select("symbol", "bar_ts", F.col("log_ret").alias("log_return"), E.obv_tilt().alias("obv_tilt"))
    w = E.feature_windows(f, 5, ["log_return", "obv_tilt"])
    assert w.filter("symbol = 'A'").count() == 900 - 1 - 4
    q = E.supervised_sequences(f, 5, ["log_return", "obv_tilt"]).filter("symbol = 'A'").orderBy("target_ts").first()
    assert [row[0] for row in q.x] == r[1:6] and q.y == r[6]


def test_variances_equal_loops(bars):
    t = R.with_returns(bars)
    r = [x for x in column(t, "ret") if x is not None]
    v = float(np.var(r[:30], ddof=1))
    for x in r[30:]:
        v = 0.94 * v + 0.06 * x * x
    assert math.isclose(column(V.ewma_variance(t), "ewma_var")[-1], v, rel_tol=1e-9)
    g = float(np.var(r[-60:], ddof=1))
    for x in r[-60:]:
        g = 1e-6 + 0.05 * x * x + 0.9 * g
    assert math.isclose(column(V.garch_variance(t), "garch_var")[-1], g, rel_tol=1e-9)


def test_covariance_equals_numpy(bars):
    t = R.with_returns(bars)
    c = V.rolling_covariance(t, 250).filter("bar_ts = timestamp_ntz'2024-08-01'").collect()
    a = t.filter("bar_ts <= timestamp_ntz'2024-08-01'").toPandas().pivot(index="bar_ts", columns="symbol", values="ret").dropna().tail(250)
    want = np.cov(a.to_numpy().T)
    assert {(r.sym_i, r.sym_j): round(r["cov"], 12) for r in c} == {("A", "A"): round(want[0, 0], 12), ("A", "B"): round(want[0, 1], 12), ("B", "B"): round(want[1, 1], 12)}


def test_optimiser_and_caps_keep_their_bounds(spark):
    mu = np.array([0.02, -0.01, 0.05])
    w = H.solve_weights(mu, 0.01 * np.eye(3), None, 5.0, 0.1, 1.0, np.full(3, 5.0))
    assert np.allclose(w, mu / 0.25)
    pulled = H.solve_weights(mu, 0.01 * np.eye(3), np.array([0.3, 0.3, 0.3]), 5.0, 10.0, 1.0, np.full(3, 5.0))
    assert np.all(np.abs(pulled - 0.3) < np.abs(w - 0.3))
    df = spark.createDataFrame([("s", T0, x, v) for x, v in zip("ABCDEF", (0.9, 0.8, -0.1, 0.4, 0.3, 0.0), strict=True)], H.WEIGHTS)
    capped = [r.weight for r in H.apply_exposure_caps(df).collect()]
    assert max(capped) <= 0.3 and min(capped) >= -0.3 and abs(sum(capped)) <= 0.25 + 1e-9


def test_orders_say_why_not(spark):
    c = spark.createDataFrame([("s", T0, "A", 0.0, 0.1), ("s", T0, "B", 0.1, 0.10005), ("s", T0, "C", 0.0, 0.1), ("s", T0, "D", 0.0, 0.001)], "strategy_id string, bar_ts timestamp_ntz, symbol string, w_prev double, w_new double")
    prices = spark.createDataFrame([(T0, "A", 50.0), (T0, "B", 50.0), (T0, "D", 50.0)], "bar_ts timestamp_ntz, symbol string, close double")
    filters = spark.createDataFrame([(s, 0.1, 0.1, 5.0, 1.0) for s in "ABCD"], "symbol string, step_size double, min_qty double, min_notional double, multiplier double")
    got = {r.symbol: r for r in H.generate_orders(c, prices, filters, 1000.0).collect()}
    assert got["A"].skip_reason is None and got["A"].side == "buy" and math.isclose(got["A"].quantity, 2.0)
    assert [got[s].skip_reason for s in "BCD"] == ["small_change", "no_price", "min_notional"]


def test_ledger_by_hand(spark):
    fills = [("a", "A", T0 + timedelta(hours=i), i, side, q, px, 1.0) for i, (side, q, px) in enumerate([("buy", 1.0, 100.0), ("buy", 1.0, 110.0), ("sell", 1.0, 120.0), ("sell", 3.0, 90.0), ("buy", 2.0, 80.0)])]
    f = spark.createDataFrame(fills, "account string, symbol string, ts timestamp_ntz, seq long, side string, qty double, price double, leverage double")
    got = J.position_ledger(J.price_fills(f, 0.0, 0.0)).orderBy("seq").collect()
    assert [r.action for r in got] == ["open", "add", "reduce", "flip", "close"]
    assert [r.entry for r in got] == [100.0, 105.0, 105.0, 90.0, None]
    assert [r.realized for r in got] == [0.0, 0.0, 15.0, -15.0, 20.0] and math.isclose(got[-1].cash, 20.0)
    marks = spark.createDataFrame([("A", T0 + timedelta(hours=1, minutes=30), 115.0)], "symbol string, ts timestamp_ntz, mark double")
    e = J.equity_curve(J.position_ledger(J.price_fills(f, 0.0, 0.0)), marks, 1000.0).first()
    assert math.isclose(e.equity, 1000 + 2 * 10)


def test_performance_by_hand(spark):
    nav = [100.0, 110.0, 105.0, 120.0, 115.0]
    e = spark.createDataFrame([("s", T0 + timedelta(days=i), v) for i, v in enumerate(nav)], "strategy_id string, bar_ts timestamp_ntz, nav double")
    s = K.performance_summary(e, "1d", 100.0).first()
    r = np.diff(nav) / nav[:-1]
    assert math.isclose(s.sharpe, r.mean() / r.std(ddof=1) * math.sqrt(365)) and math.isclose(s.max_drawdown, 5 / 110) and math.isclose(s.cum_return_pct, 15.0)
    flat = spark.createDataFrame([("s", T0, 1.0)], "strategy_id string, bar_ts timestamp_ntz, nav double")
    assert K.performance_summary(flat, "1d", 1.0).first().sharpe == 0.0


def test_empty_bars(spark):
    none = spark.createDataFrame([], BARS)
    assert R.with_returns(none).count() == G.latest_bars(none).count() == scan.ema(none, "close", 3, "e").count() == 0
