"""The daily universe on a stream: closed days' dollar volumes go in, one list for each day comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.operators.universe import universe_by_day
from barspan.streaming.bars import daily_dollar_volume
from barspan.streaming.state import rocksdb_state

_VOLUMES = "symbol string, day date, dollar_volume double, month string, batch long"
_LISTS = "day date, symbol string, rank int, month string, batch long"


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def _replace(df: DataFrame, number: int, path: str) -> None:
    """Write df by month and batch; what an earlier run of the batch wrote there is replaced, all else stays as it is."""
    rows = df.withColumn("month", _month(F.col("day"))).withColumn("batch", F.lit(number).cast("long"))
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)


def refresh_universe(bars: DataFrame, ranks: DataFrame, path: str, checkpoint: str, k: int, floor: float, lookback: int, delay: str = "1 day", default: list[str] | None = None):
    """Start a query that writes the universe of each day, once the watermark has closed the day, to path/lists.

    bars: a stream (symbol, close, volume, event_ts); ranks: (symbol, rank) by market cap. A micro-batch stores the volumes of
    the days that it closes by month, reads those within the lookback (other months aren't opened), selects, and writes the
    lists of its days under its number. A day closes once, and a batch that runs again replaces what it wrote, so that each
    day keeps one list. Days on which nothing qualifies get the default list, if there is one.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _replace(batch.select("symbol", "dollar_volume", F.col("day").cast("date").alias("day")), number, f"{path}/volumes")
        written = spark.read.schema(_VOLUMES).parquet(f"{path}/volumes")
        days = written.filter(F.col("batch") == number)  # from here on, so that the batch's state is worked out once
        span = days.agg(F.min("day"), F.max("day")).first()  # two dates
        if span[0] is None:
            return
        first, last = F.date_sub(F.lit(span[0]), lookback), F.lit(span[1])
        stored = written.filter(F.col("month").between(_month(first), _month(last)) & (F.col("batch") <= number))
        known = stored.filter(F.col("day").between(first, last)).select("symbol", "day", "dollar_volume")
        lists = universe_by_day(ranks, known, k, floor, lookback).filter(F.col("day") >= F.lit(span[0])).select("day", "symbol", F.col("rank").cast("int").alias("rank"))
        if default:
            spare = days.select("day").distinct().join(lists, "day", "left_anti").select(F.posexplode(F.array(*map(F.lit, default))).alias("n", "symbol"), "day")
            lists = lists.unionByName(spare.select("day", "symbol", (F.col("n") + 1).cast("int").alias("rank")))
        _replace(lists, number, f"{path}/lists")

    valid = bars.filter("close > 0 and volume is not null")
    with rocksdb_state(bars.sparkSession):
        return daily_dollar_volume(valid, delay).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(day, symbol, rank, batch) of all days that are closed."""
    return spark.read.schema(_LISTS).parquet(f"{path}/lists").select("day", "symbol", "rank", "batch")
