"""Least squares over folds, tables that are updated in place, sliding medians, and a history that a stream repeats."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.operators import forecast as I
from barspan.operators import universe as U
from barspan.sources import readers as A
from barspan.streaming import bars as M
from barspan.streaming.stateful import after_history

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_fits_over_folds_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    rows, folds = [], spark.createDataFrame([(i, T0 + (20 + 30 * i) * DAY, T0 + (50 + 30 * i) * DAY) for i in range(4)], "fold int, anchor timestamp_ntz, fold_end timestamp_ntz")
    for symbol, start, n in (("A", 0, 130), ("B", 55, 60), ("C", 0, 12)):
        for i in range(n):
            a, b = rng.normal(), rng.normal() + 5
            c = 1.5 if symbol == "C" else a - b + rng.normal()
            rows.append((symbol, T0 + (start + i) * DAY, a, b, c, 2 * a - b + 0.5 * c + rng.normal() / 10 if i % 11 else None))
    df = spark.createDataFrame(rows, "symbol string, target_ts timestamp_ntz, a double, b double, c double, y double")
    got = {(r["symbol"], r["fold"]): r for r in I.fit_linear(df, ["a", "b", "c"], "y", folds).collect()}
    want = set()
    for fold in range(4):
        for symbol in "ABC":
            seen = np.array([r[2:] for r in rows if r[0] == symbol and r[1] < T0 + (20 + 30 * fold) * DAY and r[5] is not None], float)
            if not len(seen):
                continue
            want.add((symbol, fold))
            x, y = seen[:, :-1], seen[:, -1]
            beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
            r = got[symbol, fold]
            assert r["n"] == len(seen) and np.allclose(r["coefficients"], beta, atol=1e-6) and np.isclose(r["intercept"], y.mean() - x.mean(0) @ beta, atol=1e-6), (symbol, fold)
    assert set(got) == want
    test = I.assign_folds(df, folds).filter("part = 'test'")
    told = I.predict_linear(test, I.fit_linear(df, ["a", "b", "c"], "y", folds), ["a", "b", "c"]).filter("symbol = 'A' and y is not null")
    assert told.agg(F.max(F.abs(F.col("y_pred") - F.col("y")))).first()[0] < 0.6


def month_bars(spark, days, close):
    rows = [(s, T0 + i * DAY, close, close, close, close, 1.0) for s in ("A", "B") for i in days]
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")


def files(path):
    return {f"{p.parent.parent.name}/{p.parent.name}": p.name for p in path.rglob("*.parquet")}


def test_an_upsert_leaves_other_months_alone(spark, tmp_path):
    path = tmp_path / "bars"
    A.write_months(month_bars(spark, range(0, 90), 1.0), str(path))
    before = files(path)
    new = month_bars(spark, [40, 95], 2.0).filter("symbol = 'B'")
    A.upsert_months(new.unionByName(new), str(path), str(tmp_path / "staged"))
    after = files(path)
    assert {k for k in after if before.get(k) != after[k]} == {"symbol=B/month=2024-02", "symbol=B/month=2024-04"}
    rows = {(r["symbol"], (r["bar_ts"] - T0).days): r["close"] for r in A.read_months(spark, str(path)).collect()}
    assert len(rows) == 181 and {k for k, v in rows.items() if v == 2.0} == {("B", 40), ("B", 95)}


def test_an_upsert_that_dies_leaves_the_table(spark, tmp_path):
    path = tmp_path / "bars"
    A.write_months(month_bars(spark, range(0, 60), 1.0), str(path))
    before = files(path)
    bad = month_bars(spark, [3, 40], 2.0).withColumn("close", F.when(F.dayofmonth("bar_ts") > 5, F.raise_error(F.lit("cut off")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="cut off"):
        A.upsert_months(bad, str(path), str(tmp_path / "staged"))
    assert files(path) == before and A.read_months(spark, str(path)).filter("close = 2.0").isEmpty()


def test_medians_slide(spark):
    rnd, lookback = random.Random(4), 7
    days = {s: sorted(rnd.sample(range(1200), 500)) for s in "AB"}
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), rnd.choice([None, 1.0, 2.0, rnd.random() * 10])) for s in days for i in days[s]]
    df = spark.createDataFrame(rows, "symbol string, day date, v double").repartition(4)
    got = {(r["symbol"], r["day"]): r["m"] for r in U.rolling_median(df, "v", lookback, "m").collect()}
    assert len(got) == len(rows)
    for s, day, _ in rows:
        seen = [v for t, d, v in rows if t == s and v is not None and 0 <= (day - d).days <= lookback]
        assert got[s, day] == (statistics.median(seen) if seen else None)
    assert U.rolling_median(df.limit(0), "v", lookback, "m").count() == 0


def test_a_stream_that_repeats_the_history(spark, tmp_path):
    schema = "symbol string, close double, event_ts timestamp"
    history = spark.createDataFrame([("A", T0 + i * DAY, 1.0) for i in range(5)], "symbol string, bar_ts timestamp_ntz, close double")
    run = lambda: sorted((r["symbol"], (r["event_ts"] - T0).days) for r in M.run_available(after_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), history), str(tmp_path / "out"), str(tmp_path / "state")).collect())
    for part, want in (([("A", 3), ("A", 4), ("A", 5), ("B", 1)], [("A", 5), ("B", 1)]), ([("A", 2), ("A", 5), ("A", 6), ("B", 1)], [("A", 5), ("A", 6), ("B", 1)])):
        spark.createDataFrame([(s, 1.0, T0 + i * DAY) for s, i in part], schema).write.mode("append").parquet(str(tmp_path / "in"))
        assert run() == want
