"""Streams that stop and go on: late rows, timers, rates consumed once, lists that a repeated batch leaves alone, seeded state."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.operators import features as E
from barspan.operators.features import winsor_z_values
from barspan.operators.order_stats import SortedBlocks, winsor_z_next
from barspan.streaming import bars as M
from barspan.streaming import stateful as N
from barspan.streaming import universe as U
from barspan.streaming.features import feature_updates, live_features

EVENT_BARS = "symbol string, open double, high double, low double, close double, volume double, event_ts timestamp"
HOUR = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 3, 1)


class Landed:
    """A stream that reads one file after another; what comes out is read after each."""

    def __init__(self, spark, tmp_path, schema, name="in"):
        self.spark, self.schema, self.path = spark, schema, str(tmp_path / name)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def bars_of(symbol, prices, start=T0, step=HOUR):
    return [(symbol, float(p), p + 1.0, p - 1.0, float(p), 10.0 + i % 5, start + i * step) for i, p in enumerate(prices)]


@pytest.mark.parametrize("every", [None, "30m"])
def test_tick_windows_close_in_append_mode_and_late_ticks_fall_out(spark, tmp_path, every):
    schema = "symbol string, event_ts timestamp, px double, seq long"
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    landed, out = Landed(spark, tmp_path, schema), (str(tmp_path / "out"), str(tmp_path / "state"))
    run = lambda: M.run_available(M.tick_bars(landed.stream(), "1h", "1 hour", every), *out).orderBy("symbol", "bar_ts").collect()
    landed.add([("A", at(5), 1.0, 1), ("A", at(50), 3.0, 2)])
    assert run() == []  # nothing is over yet
    landed.add([("A", at(130), 5.0, 4), ("A", at(20), 2.0, 3)])  # the second is late, but within the delay
    landed.add([("A", at(300), 9.0, 5)])
    first = {r["bar_ts"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in run()}
    assert first[at(0)] == (1.0, 3.0, 1.0, 3.0, 3.0)
    if every:
        assert first[at(30)] == (3.0, 3.0, 3.0, 3.0, 1.0) and first[at(-30)] == (1.0, 2.0, 1.0, 2.0, 2.0) and first[at(120)] == first[at(90)] == (5.0, 5.0, 5.0, 5.0, 1.0)
    else:
        assert set(first) == {at(0), at(120)}
    landed.add([("A", at(40), 77.0, 6), ("A", at(600), 1.0, 7)])  # later than the watermark allows
    again = {r["bar_ts"]: r["high"] for r in run()}
    assert 77.0 not in again.values() and again[at(300)] == 9.0


def test_silent_symbols_are_reported_then_forgotten(spark, tmp_path):
    landed, out = Landed(spark, tmp_path, EVENT_BARS), (str(tmp_path / "out"), str(tmp_path / "state"))
    told = lambda: sorted(((r["bar_ts"] - T0) // HOUR for r in M.run_available(N.gaps(landed.stream(), "1h", "0 seconds", 5), *out).filter("symbol = 'A'").collect()))
    landed.add(bars_of("A", [1, 2], T0) + bars_of("B", [1], T0))
    assert told() == []
    landed.add(bars_of("B", range(1, 4), T0 + HOUR))  # A has nothing at 2 and 3
    assert told() == [2, 3]
    landed.add(bars_of("A", [5], T0 + 4 * HOUR) + bars_of("B", [9], T0 + 4 * HOUR))
    assert told() == [2, 3]  # it came back in time: nothing twice
    landed.add(bars_of("B", [9], T0 + 40 * HOUR))
    assert told() == [2, 3, 5, 6, 7, 8, 9]  # five steps, then A is forgotten
    landed.add(bars_of("A", [7], T0 + 41 * HOUR) + bars_of("B", [9], T0 + 41 * HOUR))
    assert told() == [2, 3, 5, 6, 7, 8, 9]  # and starts anew


def test_order_state_goes_with_the_watermark(spark, tmp_path):
    landed, out = Landed(spark, tmp_path, EVENT_BARS), (str(tmp_path / "out"), str(tmp_path / "state"))
    kept = lambda: sorted((r["symbol"], (r["event_ts"] - T0) // HOUR) for r in M.run_available(N.in_order(landed.stream(), "2 hours"), *out).collect())
    landed.add(bars_of("A", [1, 2, 3], T0))
    landed.add(bars_of("A", [9], T0 + HOUR) + bars_of("B", [1], T0 + 30 * HOUR))  # A's is older than its last
    assert kept() == [("A", 0), ("A", 1), ("A", 2), ("B", 30)]
    landed.add(bars_of("A", [9], T0 + HOUR) + bars_of("A", [4], T0 + 31 * HOUR))  # older than the watermark, though A was forgotten
    assert kept() == [("A", 0), ("A", 1), ("A", 2), ("A", 31), ("B", 30)]


def test_a_rate_goes_to_one_bar(spark, tmp_path):
    bars, rates = Landed(spark, tmp_path, "symbol string, close double, event_ts timestamp"), Landed(spark, tmp_path, "symbol string, funding_ts timestamp, rate double", "rates")
    out = (str(tmp_path / "out"), str(tmp_path / "state"))
    at = lambda h: T0 + dt.timedelta(minutes=int(60 * h))
    run = lambda: {(r["symbol"], (r["event_ts"] - T0) / HOUR): r["funding"] for r in M.run_available(N.next_funding(bars.stream(), rates.stream(), "1 hour", "12 hours"), *out).collect()}
    rates.add([("A", at(0.5), 0.1), ("A", at(1.2), 0.2), ("A", at(1.9), 0.3), ("B", at(0), 0.7)])
    bars.add([("A", 1.0, at(1)), ("A", 1.0, at(2)), ("A", 1.0, at(3)), ("B", 1.0, at(0))])
    run()
    rates.add([("A", at(4.5), 0.4), ("A", at(9), 0.5), ("C", at(5), 0.6)])
    bars.add([("A", 1.0, at(6)), ("A", 1.0, at(7)), ("A", 1.0, at(9)), ("C", 1.0, at(18))])
    run()
    rates.add([("~", at(99), 0.0)])
    bars.add([("~", 1.0, at(99))])
    got = run()
    # Of two rates for one bar the newer counts; a missing bar leaves its rate to the next; C's rate is too old for its bar.
    assert got == {("A", 1): 0.1, ("A", 2): 0.3, ("A", 3): 0.0, ("A", 6): 0.4, ("A", 7): 0.0, ("A", 9): 0.5, ("B", 0): 0.7, ("C", 18): 0.0}


def test_a_batch_that_runs_again_leaves_one_list(spark, tmp_path):
    landed, path = Landed(spark, tmp_path, EVENT_BARS), str(tmp_path / "universe")
    ranks = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "symbol string, rank int")
    day = dt.timedelta(days=1)

    def run(state):
        U.refresh_universe(landed.stream(), ranks, path, str(tmp_path / state), 2, 500.0, 2, "0 seconds", ["Z"]).awaitTermination()
        return sorted((r["day"].day, r["rank"], r["symbol"], r["batch"]) for r in U.read_universe(spark, path).collect())

    landed.add(bars_of("A", [100, 10, 10, 10, 10], T0, day) + bars_of("B", [100], T0 + 3 * day, day) + bars_of("C", [900], T0, day))
    landed.add(bars_of("~", [1], T0 + 9 * day, day))
    first = run("state")
    # A's median over three days falls below the floor on the third; C's rank is too low; a day without any takes the default.
    assert [x[:3] for x in first] == [(1, 1, "A"), (2, 1, "A"), (3, 1, "Z"), (4, 2, "B"), (5, 2, "B")] or [x[:3] for x in first][:3] == [(1, 1, "A"), (2, 1, "A"), (3, 1, "Z")]
    assert run("state") == first  # nothing new
    assert run("state-lost") == first  # all batches run again under the same numbers


def walk(n, seed, symbol, start=T0):
    rnd = random.Random(seed)
    out, p = [], 100.0
    for i in range(n):
        p = max(1.0, p * math.exp(rnd.gauss(0, 0.02)) if i % 9 else p)
        out.append((symbol, p, p * (1 + rnd.random() / 50), p * (1 - rnd.random() / 50), p, rnd.choice([0.0, 10.0, rnd.random() * 1e6]), start + i * HOUR))
    return out


@pytest.mark.parametrize("known", [0, 17, 700])
def test_live_features_equal_batch_features_from_any_history(spark, tmp_path, known):
    """Seeded before windows are full, just after, and with many blocks; then two runs of the stream."""
    every = walk(900, 1, "A") + walk(650, 2, "B", T0 + 50 * HOUR)
    cut = T0 + known * HOUR
    df = spark.createDataFrame(every, EVENT_BARS)
    batch = df.withColumn("bar_ts", F.col("event_ts").cast("timestamp_ntz")).drop("event_ts")
    funding = batch.filter("hour(bar_ts) % 8 = 0").select("symbol", F.col("bar_ts").alias("ts"), (F.hour("bar_ts") / 1e4).alias("rate"))
    want = {(r["symbol"], r["bar_ts"]): r for r in E.feature_frame(batch, funding, 60).filter(F.col("bar_ts") >= F.lit(cut).cast("timestamp_ntz")).collect()}
    landed, out = Landed(spark, tmp_path, EVENT_BARS), str(tmp_path / "out")
    history = batch.filter(F.col("bar_ts") < F.lit(cut).cast("timestamp_ntz"))
    new = [r for r in every if r[6] >= cut]
    half = cut + (T0 + 900 * HOUR - cut) / 2
    for part in ([r for r in new if r[6] < half], [r for r in new if r[6] >= half - 5 * HOUR]):  # some rows come twice
        random.Random(3).shuffle(part)
        landed.add(part)
        feature_updates(landed.stream(), history, funding, out, str(tmp_path / "state"), 60).awaitTermination()
    got = {(r["symbol"], r["bar_ts"]): r for r in spark.read.parquet(f"{out}/features").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in E.FEATURES:
            assert (got[k][c] is None) == (w[c] is None), (k, c)
            assert w[c] is None or math.isclose(got[k][c], w[c], rel_tol=1e-7, abs_tol=1e-7), (k, c)


def test_features_of_odd_bars(spark, tmp_path):
    rows = walk(40, 4, "A")
    rows[5] = ("A", None, None, None, None, 5.0, rows[5][6])
    rows[9] = ("A", 1.0, 2.0, 1.0, 0.0, None, rows[9][6])
    rows[12] = (*rows[12][:5], None, rows[12][6])
    batch = spark.createDataFrame(rows, EVENT_BARS).withColumn("bar_ts", F.col("event_ts").cast("timestamp_ntz")).drop("event_ts")
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz, rate double")
    want = {r["bar_ts"]: r for r in E.feature_frame(batch, none, 1).collect()}
    landed = Landed(spark, tmp_path, EVENT_BARS)
    landed.add(rows)
    got = {r["bar_ts"].replace(tzinfo=None): r for r in M.run_available(live_features(landed.stream(), warmup=1), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    for k, w in want.items():
        for c in E.FEATURES:
            assert (got[k][c] is None) == (w[c] is None) and (w[c] is None or math.isclose(got[k][c], w[c], rel_tol=1e-7, abs_tol=1e-9)), (k, c, got[k][c], w[c])


def test_sorted_blocks_equal_the_batch_scores():
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=3000), np.round(rng.normal(size=1500), 1) + 1e6, np.zeros(700), np.where(rng.random(1500) < 0.2, np.nan, rng.standard_cauchy(1500))):
        for warmup in (1, 200):
            h = SortedBlocks()
            got = [np.nan if (z := winsor_z_next(h, v, warmup, shift=x[np.isfinite(x)][0])) is None else z for v in x]
            assert np.allclose(got, winsor_z_values(x, warmup), equal_nan=True, atol=1e-9)


def test_a_value_touches_few_blocks_however_long_the_history():
    rng = np.random.default_rng(2)
    for n in (5_000, 200_000):
        values = np.sort(rng.normal(size=n))
        blocks = [values[i : i + SortedBlocks.SIZE] for i in range(0, n, SortedBlocks.SIZE)]
        loaded = []
        h = SortedBlocks(lambda k, b=blocks, seen=loaded: (seen.append(k), b[k])[1], np.array([SortedBlocks.entry(i, b) for i, b in enumerate(blocks)]))
        winsor_z_next(h, 0.3, 200)
        assert len(loaded) <= 5 and len(h.changed) == 1 and len(h) == n + 1
