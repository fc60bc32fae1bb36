"""Bar operators on Structured Streaming; event times are timestamps, since watermarks ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.functions.scalars import timeframe_ms
from barspan.sources.readers import decode_klines
from barspan.streaming.state import rocksdb_state


def stream_klines(spark: SparkSession, path: str) -> DataFrame:
    """Landed klines (JSON lines of symbol, timeframe, raw) as a stream of typed bars with event time."""
    raw = spark.readStream.schema("symbol string, timeframe string, raw string").json(path)
    return decode_klines(raw).withColumn("event_ts", F.col("bar_ts").cast("timestamp"))


def closed_only(bars: DataFrame) -> DataFrame:
    """Bars that are over by the clock of the cluster."""
    return bars.filter(F.col("close_ts").cast("timestamp") <= F.current_timestamp())


def tick_bars(ticks: DataFrame, timeframe: str, delay: str = "1 hour", every: str | None = None) -> DataFrame:
    """Ticks (symbol, event_ts, px, seq) to bars over tumbling windows, or over windows that start `every` so often.

    Late ticks within the delay count. In append mode a bar comes out, and its state goes, once the watermark passes its end.
    """
    w = F.window("event_ts", f"{timeframe_ms(timeframe)} milliseconds", every and f"{timeframe_ms(every)} milliseconds")
    k = F.struct("event_ts", "seq")
    bars = ticks.withWatermark("event_ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("px", k).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", k).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def distinct_steps(arrivals: DataFrame, timeframe: str, delay: str = "1 day") -> DataFrame:
    """One arrival of each grid step of each symbol."""
    ms = timeframe_ms(timeframe)
    grid = F.timestamp_millis(F.floor(F.unix_millis("event_ts") / ms) * ms)
    return arrivals.withColumn("event_ts", grid).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["symbol", "event_ts"])


def daily_dollar_volume(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    day = F.window("event_ts", "1 day")
    s = bars.withWatermark("event_ts", delay).groupBy("symbol", day.alias("w")).agg(F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"))
    return s.select("symbol", F.col("w.start").alias("day"), "dollar_volume")


def new_forecasts(forecasts: DataFrame, delay: str = "1 day") -> DataFrame:
    """One forecast for each new time."""
    return forecasts.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_ts"])


def with_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """The funding rate of a bar's own time from a static table, 0 where there is none."""
    rates = funding.select("symbol", F.col("ts").cast("timestamp").alias("event_ts"), F.col("rate").alias("_rate"))
    return bars.join(rates, ["symbol", "event_ts"], "left").withColumn("funding", F.coalesce("_rate", F.lit(0.0))).drop("_rate")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off what has landed, write it to parquet and read the result; a later call goes on from the checkpoint."""
    spark = stream.sparkSession
    with rocksdb_state(spark):
        if mode == "append":
            q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        else:
            q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def alert_batches(metrics: DataFrame, limits: DataFrame, path: str, checkpoint: str):
    """Append to JSON what exceeds its limit in each micro-batch."""
    from barspan.operators.monitor import alerts

    return metrics.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: alerts(df, limits).write.mode("append").json(path)).start()
