"""Bars on a time grid: resampling, dedupe, gaps, latest rows, carrying forward, closed-bar filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from barspan.functions.scalars import align, normalize_symbol, timeframe_ms


def by_symbol():
    """The order that all bar operators share, so that one exchange by symbol serves them all."""
    return Window.partitionBy("symbol").orderBy("bar_ts")


def step_interval(timeframe: str) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timeframe_ms(timeframe) / 1000).cast("decimal(18,6)"))


def resample_bars(ticks: DataFrame, timeframe: str, key: list[str], price: str = "px", quantity: str = "qty", ts: str = "ts") -> DataFrame:
    """Ticks (symbol, ts, price, quantity) to bars; key orders ticks within a bar. Partial aggregates run before the shuffle."""
    k = F.struct(*key)
    return ticks.groupBy("symbol", align(F.col(ts), timeframe).alias("bar_ts")).agg(
        F.min_by(price, k).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, k).alias("close"), F.sum(quantity).alias("volume")
    )


def _by_arrival(arrivals: DataFrame, ts: str, arrival: str) -> list[str]:
    """The order of arrival; those that arrive together come by time, then by the other columns that have an order."""
    simple = [f.name for f in arrivals.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in (arrival, ts)]
    return [arrival, ts, *simple]


def first_per_step(arrivals: DataFrame, timeframe: str, ts: str = "bar_ts", arrival: str = "arrival_seq") -> DataFrame:
    """Align and keep the first arrival of each grid step of each symbol."""
    grid = arrivals.withColumn(ts, align(F.col(ts), timeframe))
    return grid.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", ts).orderBy(*_by_arrival(arrivals, ts, arrival)))).filter("_n = 1").drop("_n")


def drop_out_of_order(arrivals: DataFrame, ts: str = "bar_ts", arrival: str = "arrival_seq") -> DataFrame:
    """Keep arrivals that are later than all earlier arrivals of their symbol."""
    before = Window.partitionBy("symbol").orderBy(*_by_arrival(arrivals, ts, arrival)).rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("_high", F.max(ts).over(before)).filter(F.col("_high").isNull() | (F.col(ts) > F.col("_high"))).drop("_high")


def seen_before(arrivals: DataFrame, ts: str = "bar_ts", arrival: str = "arrival_seq") -> DataFrame:
    """Flag arrivals whose time any symbol has reported before; rows stay."""
    return arrivals.withColumn("seen_before", F.row_number().over(Window.partitionBy(ts).orderBy(*_by_arrival(arrivals, ts, arrival))) > 1)


def missing_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Every grid step between two consecutive bars of a symbol: (symbol, bar_ts)."""
    step = step_interval(timeframe)
    gaps = bars.select("symbol", "bar_ts", F.lag("bar_ts").over(by_symbol()).alias("_from")).filter(F.col("bar_ts") > F.col("_from") + step)
    return gaps.select("symbol", F.explode(F.sequence(F.col("_from") + step, F.col("bar_ts") - step, step)).alias("bar_ts"))


def bar_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    """All grid steps from each symbol's first to its last bar: (symbol, bar_ts)."""
    ends = bars.groupBy("symbol").agg(F.min("bar_ts").alias("lo"), F.max("bar_ts").alias("hi"))
    return ends.select("symbol", F.explode(F.sequence("lo", "hi", step_interval(timeframe))).alias("bar_ts"))


def missing_from_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    return bar_grid(bars, timeframe).join(bars.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_anti")


def missing_ranges(bars: DataFrame, timeframe: str, start: str, end: str) -> DataFrame:
    """Ranges (symbol, from_ts, to_ts) still to be fetched so that [start, end] is covered at both ends and inside."""
    lo, hi, step = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), step_interval(timeframe)
    held = bars.filter(F.col("bar_ts").between(lo, hi))
    ends = bars.select("symbol").distinct().join(held.groupBy("symbol").agg(F.min("bar_ts").alias("first"), F.max("bar_ts").alias("last")), "symbol", "left")
    none = ends.filter("first is null").select("symbol", lo.alias("from_ts"), hi.alias("to_ts"))
    head = ends.filter(F.col("first") > lo).select("symbol", lo.alias("from_ts"), (F.col("first") - step).alias("to_ts"))
    tail = ends.filter(F.col("last") + step <= hi).select("symbol", (F.col("last") + step).alias("from_ts"), hi.alias("to_ts"))
    inner = held.select("symbol", "bar_ts", F.lag("bar_ts").over(by_symbol()).alias("_from")).filter(F.col("bar_ts") > F.col("_from") + step).select("symbol", (F.col("_from") + step).alias("from_ts"), (F.col("bar_ts") - step).alias("to_ts"))
    return reduce(DataFrame.unionByName, [none, head, tail, inner])


def last_n(bars: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("bar_ts"))
    return bars.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def latest_bars(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """The newest bar of each symbol, no later than as_of; an aggregate, so hot symbols combine before the shuffle."""
    rows = bars if as_of is None else bars.filter(F.col("bar_ts") <= F.lit(as_of).cast("timestamp_ntz"))
    rest = [c for c in bars.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), "bar_ts").alias("_b")).select("symbol", "_b.*")


def quality_report(bars: DataFrame, timeframe: str, outlier_z: float | None = None) -> DataFrame:
    """(symbol, missing, outliers); outliers are closes whose log return is over outlier_z deviations off, 0 without it."""
    missing = missing_bars(bars, timeframe).groupBy("symbol").agg(F.count("*").alias("missing"))
    report = bars.select("symbol").distinct().join(missing, "symbol", "left")
    if outlier_z is None:
        return report.select("symbol", F.coalesce("missing", F.lit(0)).alias("missing"), F.lit(0).cast("long").alias("outliers"))
    r = bars.select("symbol", (F.ln("close") - F.ln(F.lag("close").over(by_symbol()))).alias("r"))
    z = r.join(r.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")), "symbol").filter(F.abs(F.col("r") - F.col("m")) > outlier_z * F.col("s"))
    out = z.groupBy("symbol").agg(F.count("*").alias("outliers"))
    return report.join(out, "symbol", "left").select("symbol", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("outliers", F.lit(0)).alias("outliers"))


def clock(bars: DataFrame) -> DataFrame:
    return bars.select("bar_ts").distinct()


def locf(bars: DataFrame, times: DataFrame, value: str = "close") -> DataFrame:
    """(symbol, bar_ts, value) on every time of the clock from a symbol's first bar on, carrying the last value forward."""
    # The clock is small beside the bars: one row for each time, spread to symbols from their first bar on.
    starts = bars.groupBy("symbol").agg(F.min("bar_ts").alias("_start"), F.max("bar_ts").alias("_end"))
    dense = times.join(starts, times["bar_ts"] >= starts["_start"]).select("symbol", "bar_ts")
    joined = dense.join(bars.select("symbol", "bar_ts", value), ["symbol", "bar_ts"], "left")
    carried = F.last(value, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("symbol", "bar_ts", carried.alias(value))


def in_universe(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows whose symbol, in its normal form, is among the configured symbols."""
    wanted = symbols.select(normalize_symbol(F.col("symbol")).alias("_symbol"))
    return rows.join(wanted, normalize_symbol(rows["symbol"]) == wanted["_symbol"], "left_semi")


def closed_bars(bars: DataFrame, as_of: str, timeframe: str) -> DataFrame:
    """Bars that are over at as_of."""
    return bars.filter(F.col("bar_ts") + step_interval(timeframe) <= F.lit(as_of).cast("timestamp_ntz"))


def closed_history(bars: DataFrame, now: str, timeframe: str, n: int) -> DataFrame:
    """The newest n bars that opened before the grid step of now."""
    return last_n(bars.filter(F.col("bar_ts") < align(F.lit(now).cast("timestamp_ntz"), timeframe)), n)


def warmup_split(bars: DataFrame, start: str) -> DataFrame:
    return bars.withColumn("phase", F.when(F.col("bar_ts") < F.lit(start).cast("timestamp_ntz"), "warmup").otherwise("test"))


def history_days(lookback_bars: int, timeframe: str, least: int = 90, slack: int = 30) -> int:
    """Days of history that a lookback asks for."""
    return max(least, int(lookback_bars * timeframe_ms(timeframe) / 86_400_000 + slack))
