"""Tradable universe: ranks by market cap, daily dollar volume, medians and selection."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def cap_ranks(caps: DataFrame, keep_stale: bool = False) -> DataFrame:
    """(symbol, rank) in the latest snapshot, largest cap first, ties by symbol; keep_stale adds earlier symbols' last ranks."""
    ranked = caps.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_ts").orderBy(F.desc("cap"), "symbol")))
    last = ranked.groupBy("symbol").agg(F.max_by("rank", "snapshot_ts").alias("rank"), F.max("snapshot_ts").alias("snapshot_ts"))
    if keep_stale:
        return last.select("symbol", "rank")
    newest = caps.agg(F.max("snapshot_ts").alias("newest"))
    # One row: the time of the newest snapshot.
    return last.join(F.broadcast(newest), F.col("snapshot_ts") == F.col("newest")).select("symbol", "rank")


def default_ranks(spark: SparkSession, symbols: list[str]) -> DataFrame:
    return spark.createDataFrame([(symbols,)], "s array<string>").select(F.posexplode("s").alias("rank", "symbol")).select("symbol", (F.col("rank") + 1).alias("rank"))


def daily_dollar_volume(bars: DataFrame) -> DataFrame:
    valid = bars.filter("close > 0 and volume is not null")
    return valid.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"))


def prune_days(daily: DataFrame, as_of: str, lookback: int) -> DataFrame:
    return daily.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), lookback))


def median_volume(daily: DataFrame, symbols: DataFrame, as_of: str, lookback: int) -> DataFrame:
    """Median daily dollar volume of each symbol in the days up to as_of, 0 where there are none."""
    m = prune_days(daily, as_of, lookback).filter(F.col("day") <= F.lit(as_of).cast("date")).groupBy("symbol").agg(F.median("dollar_volume").alias("median_volume"))
    return symbols.join(m, "symbol", "left").withColumn("median_volume", F.coalesce("median_volume", F.lit(0.0)))


def select_universe(ranks: DataFrame, medians: DataFrame, k: int, floor: float, default: list[str] | None = None) -> DataFrame:
    """(symbol, rank): ranks up to k with enough volume, at most k of them; the default list where none qualifies."""
    chosen = ranks.join(medians, "symbol").filter((F.col("rank") <= k) & (F.col("median_volume") >= floor)).orderBy("rank", "symbol").limit(k).select("symbol", "rank")
    if not default:
        return chosen
    spare = default_ranks(ranks.sparkSession, default).crossJoin(F.broadcast(chosen.agg(F.count("*").alias("n")))).filter("n = 0").drop("n")  # one row
    return chosen.unionByName(spare)


def rolling_median(daily: DataFrame, value: str, lookback: int, out: str) -> DataFrame:
    """Add the median of the value over the days from `lookback` before each row's day up to it, by symbol; missing values don't count.

    A symbol is cut into spans of days, each with the lookback before it as well, which are sorted and streamed: a window
    in order of value takes each row in and lets it go once, so that the time is in proportion to the rows.
    """
    span = max(8 * lookback, 256)
    at = F.unix_date("day")
    copies = F.when(at % span >= span - lookback, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = daily.withColumn("_later", F.explode(copies)).withColumn("_span", F.floor(at / span) + F.col("_later")).withColumn("_at", at)
    schema = StructType([*daily.schema.fields, StructField(out, DoubleType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, ordered = None, deque(), []
        for pdf in pdfs:
            medians = []
            days, values = pdf["_at"].tolist(), pdf[value].tolist()
            for i, (symbol, part) in enumerate(zip(pdf["symbol"], pdf["_span"], strict=True)):
                if (symbol, part) != key:
                    key, held, ordered = (symbol, part), deque(), []
                while held and held[0][0] < days[i] - lookback:
                    del ordered[bisect_left(ordered, held.popleft()[1])]
                v = values[i]
                if v is not None and v == v:
                    held.append((days[i], v))
                    insort(ordered, v)
                n = len(ordered)
                medians.append((ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else None)
            made = pdf.assign(**{out: pd.array(medians, dtype="Float64")})
            yield made[made["_later"] == 0][schema.names]

    ordered = rows.repartition("symbol", "_span").sortWithinPartitions("symbol", "_span", "_at")
    return ordered.mapInPandas(run, schema)


def universe_by_day(ranks: DataFrame, daily: DataFrame, k: int, floor: float, lookback: int) -> DataFrame:
    """(day, symbol, rank) for every day: the selection with that day's lookback."""
    medians = rolling_median(daily.select("symbol", "day", "dollar_volume"), "dollar_volume", lookback, "m")
    return medians.join(ranks.filter(F.col("rank") <= k), "symbol").filter(F.col("m") >= floor).select("day", "symbol", "rank")


def universe_changes(by_day: DataFrame) -> DataFrame:
    """(day, n, changed): whether the ordered list of symbols differs from that of the day before in the table."""
    lists = by_day.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    # One row a day; the order over days is global.
    prev = F.lag("symbols").over(Window.orderBy("day"))
    return lists.select("day", F.size("symbols").cast("long").alias("n"), F.coalesce(~F.col("symbols").eqNullSafe(prev), F.lit(True)).alias("changed"))
