"""Rows that the SQL comparison leaves out: near-zero variances, hedged books, funding payments."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barspan.operators import portfolio as H
from barspan.plans import portfolio_plans as P

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_hedged_and_riskless_books(spark):
    rows = [("hedged", "A", 0.4), ("hedged", "B", -0.4), ("long", "A", 0.5), ("none", "A", 0.0)]
    w = spark.createDataFrame([(s, T0, x, v) for s, x, v in rows], H.WEIGHTS)
    got = {r.strategy_id: r.scale for r in H.max_constraint_scale(w).collect()}
    assert got == {"hedged": pytest.approx(0.75), "long": pytest.approx(0.5), "none": 0.0}
    mu = spark.createDataFrame([(s, T0, x, 0.01 if x == "A" else 0.0) for s, x, _ in rows], "strategy_id string, bar_ts timestamp_ntz, symbol string, mu double")
    cov = spark.createDataFrame([(T0, a, b, 1e-7) for a in "AB" for b in "AB"], "bar_ts timestamp_ntz, sym_i string, sym_j string, cov double")
    f = {r.strategy_id: (r.var_p, r.f_star) for r in H.kelly_fraction(w, mu, cov).collect()}
    assert f["long"][1] == 2.0 and f["none"] == (0.0, 0.0) and abs(f["hedged"][0]) < 1e-15 and set(f) == {"hedged", "long", "none"}


def test_every_bar_is_returned(spark):
    bars = P.weights(spark, SF).select("strategy_id", "bar_ts").distinct().count()
    assert __spark_entry__.queries()["h05_constraint_scale_all"](spark, SF).count() == bars
    k = __spark_entry__.queries()["h03_kelly_fraction_all"](spark, SF)
    total, tiny, low, high = k.agg(F.count("*"), F.sum((F.abs("var_p") <= 1e-6).cast("int")), F.min("f_star"), F.max("f_star")).first()
    assert total == bars and tiny > 0 and low >= 0 and high <= 2


def test_trade_log_carries_funding(spark):
    got = __spark_entry__.queries()["j11_trade_log_funding"](spark, SF).groupBy("type").agg(F.count("*").alias("n"), F.count("payment").alias("paid"), F.count("qty").alias("qty")).collect()
    of = {r.type: r for r in got}
    want = __spark_entry__.queries()["j07_funding_payments"](spark, SF).count()
    assert set(of) == {"open", "close", "funding"} and of["funding"].n == of["funding"].paid == want > 0 and of["funding"].qty == 0
