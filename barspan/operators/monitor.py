"""Alerts and monitoring records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alerts(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (key columns, metric, value, max_value) of long metrics above their limit; limits (metric, max_value) are a small table."""
    return metrics.join(F.broadcast(limits), "metric").filter(F.col("value") > F.col("max_value"))


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("ts").agg(F.count("*").alias("assets"), F.median("mu").alias("median_mu"))


def quality_alerts(report: DataFrame) -> DataFrame:
    return report.filter("missing > 0 or outliers > 0")


def nav_jumps(equity: DataFrame, limit: float = 0.01) -> DataFrame:
    """Bars on which the NAV moved by more than the limit."""
    prev = F.lag("nav").over(Window.partitionBy("strategy_id").orderBy("bar_ts"))
    return equity.withColumn("change", F.try_divide(F.col("nav") - prev, F.abs(prev))).filter(F.abs("change") > limit)


def slow_forecasts(forecasts: DataFrame, limit_ms: float = 500.0) -> DataFrame:
    return forecasts.filter(F.col("latency_ms") > limit_ms)


def mean_rolling_error(monitors: DataFrame, key: str = "bar_ts", field: str = "rolling_msep") -> DataFrame:
    """(key, avg_rolling_msep) over a map of symbol to structs: the mean of the field, missing and NaN left out."""
    values = F.filter(F.transform(F.map_values("forecast_monitor"), lambda v: v[field]), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return monitors.select(key, F.try_divide(total, F.size(values)).alias("avg_rolling_msep"))


def risk_series(diagnostics: DataFrame, costs: DataFrame, turnover: DataFrame, key: str = "strategy_id") -> DataFrame:
    """One record for each bar that was traded: ts, the bar's diagnostics as a struct, turnover and expected costs."""
    rest = [c for c in diagnostics.columns if c != "bar_ts"]
    told = diagnostics.select("bar_ts", F.struct(*rest).alias("risk_diag"))
    rows = turnover.join(costs, [key, "bar_ts"]).join(told, "bar_ts", "left")
    return rows.select(
        key, F.unix_millis(F.col("bar_ts").cast("timestamp")).alias("ts"), "risk_diag", "turnover", F.col("total_cost").alias("expected_cost"), F.col("total_cost_bp").alias("expected_cost_bp"),
        F.col("fee_cost").alias("expected_fee"), F.col("slippage_cost").alias("expected_slippage"),
    )


def monitoring_records(metrics: DataFrame, key: str = "bar_ts") -> DataFrame:
    """One JSON record for each row: its time in milliseconds and the other columns in a struct."""
    rest = [c for c in metrics.columns if c != key]
    return metrics.select(F.to_json(F.struct(F.unix_millis(F.col(key).cast("timestamp")).alias("ts"), F.struct(*rest).alias("metrics"))).alias("record"))
