"""Performance of equity curves: returns, Sharpe, drawdown, win rates, benchmarks, haircuts, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import bars_per_day


def by_strategy():
    return Window.partitionBy("strategy_id").orderBy("bar_ts")


def bar_returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("ret", F.try_divide(F.col("nav"), F.lag("nav").over(by_strategy())) - 1)


def drawdowns(equity: DataFrame, initial: float | None = None) -> DataFrame:
    """Drawdown from the running peak, which starts at the initial capital if one is given."""
    peak = F.max("nav").over(by_strategy().rowsBetween(Window.unboundedPreceding, 0))
    peak = peak if initial is None else F.greatest(peak, F.lit(initial))
    return equity.withColumn("drawdown", F.when(peak > 0, (peak - F.col("nav")) / peak).otherwise(0.0))


def sharpe(ret: str, timeframe: str) -> Column:
    sd = F.stddev_samp(ret)
    return F.coalesce(F.when(sd > 0, F.avg(ret) / sd * math.sqrt(bars_per_day(timeframe) * 365)), F.lit(0.0))


def annual_volatility(ret: str, timeframe: str) -> Column:
    return F.coalesce(F.when(F.count(ret) >= 2, F.stddev_samp(ret) * math.sqrt(bars_per_day(timeframe) * 365)), F.lit(0.0))


def performance_summary(equity: DataFrame, timeframe: str, initial: float) -> DataFrame:
    """One row for each strategy; every figure from one pass of windows and one aggregate."""
    rows = drawdowns(bar_returns(equity))
    win = lambda test, x: F.coalesce(F.avg(F.when(test, x)), F.lit(0.0))
    r = F.col("ret")
    return rows.groupBy("strategy_id").agg(
        F.count("*").alias("bars"), (F.max_by("nav", "bar_ts") - initial).alias("pnl"), ((F.max_by("nav", "bar_ts") / initial - 1) * 100).alias("cum_return_pct"),
        sharpe("ret", timeframe).alias("sharpe"), annual_volatility("ret", timeframe).alias("volatility"), F.max("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown"),
        win(r > 0, r).alias("avg_win"), win(r < 0, -r).alias("avg_loss"), F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0)).alias("winrate_per_bar"),
    )


def win_rate_per_order(returns: DataFrame, forecasts: DataFrame, orders: DataFrame) -> DataFrame:
    """Winning bars that had a forecast over the number of orders, as orders may be several to a bar."""
    wins = returns.filter("ret > 0").join(forecasts.select("bar_ts").distinct(), "bar_ts", "left_semi").groupBy("strategy_id").agg(F.count("*").alias("wins"))
    n = orders.groupBy("strategy_id").agg(F.count("*").alias("orders"))
    return n.join(wins, "strategy_id", "left").select("strategy_id", F.coalesce("wins", F.lit(0)).alias("wins"), "orders", F.coalesce(F.try_divide("wins", "orders"), F.lit(0.0)).alias("winrate_per_order"))


def benchmark_curve(bars: DataFrame, symbol: str, capital: float) -> DataFrame:
    """Buy and hold: the capital in units at the first price, valued at every bar."""
    rows = bars.filter(F.col("symbol") == symbol).select(F.concat(F.lit("hold_"), "symbol").alias("strategy_id"), "bar_ts", "close")
    return rows.withColumn("nav", capital / F.first("close").over(by_strategy().rowsBetween(Window.unboundedPreceding, 0)) * F.col("close")).drop("close")


def turnover_stats(turnover: DataFrame, times: DataFrame) -> DataFrame:
    """Mean and sum of turnover over all bars of the clock, idle ones counting 0."""
    ids = turnover.select("strategy_id").distinct()
    dense = times.select("bar_ts").distinct().crossJoin(F.broadcast(ids))  # a row for each strategy and bar is what is asked for; strategies are a handful
    return dense.join(turnover, ["strategy_id", "bar_ts"], "left").groupBy("strategy_id").agg(F.avg(F.coalesce("turnover", F.lit(0.0))).alias("turnover_mean"), F.sum(F.coalesce("turnover", F.lit(0.0))).alias("turnover_sum"))


def ras_bounds(values: DataFrame, delta: float = 0.05, value: str = "ret", key: str = "strategy_id", standardised: bool = False) -> DataFrame:
    """Mean less the haircut sqrt(2 ln(2 / delta) / T); standardised divides the mean by the deviation first."""
    mean = F.avg(value) / F.stddev_samp(value) if standardised else F.avg(value)
    s = values.groupBy(key).agg(mean.alias("mean"), F.count(value).alias("n")).filter("n > 0")
    return s.withColumn("lower", F.col("mean") - F.sqrt(F.lit(2 * math.log(2 / delta)) / F.col("n")))


def avg_diagnostics(maps: DataFrame, column: str) -> DataFrame:
    """Mean by key over maps that need not hold all keys."""
    return maps.select(F.explode(column).alias("metric", "value")).groupBy("metric").agg(F.avg("value").alias("value"))


def against_benchmark(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select("bar_ts", F.col("nav").alias("benchmark_nav"))
    return equity.join(b, "bar_ts").select("strategy_id", "bar_ts", "nav", "benchmark_nav")


def summary_with_benchmark(summary: DataFrame, benchmark: DataFrame) -> DataFrame:
    one = benchmark.drop("strategy_id", "bars")
    return summary.crossJoin(F.broadcast(one.select(*[F.col(c).alias(f"benchmark_{c}") for c in one.columns])))  # one row


def long_metrics(summary: DataFrame) -> DataFrame:
    names = [c for c, t in summary.dtypes if t == "double"]
    return summary.unpivot(["strategy_id"], names, "metric", "value")
