"""Market tables derived from the supplied tables, for Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.operators.grid import resample_bars

KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _line_ticks(spark, d, symbol):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, d, "lineitem").select(symbol.alias("symbol"), px.alias("px"), *KEY).filter("px > 0")


def daily_bars(spark, d) -> DataFrame:
    return resample_bars(_line_ticks(spark, d, F.concat("l_returnflag", "l_linestatus")), "1d", KEY, "px", "l_quantity", "l_shipdate")


def wide_bars(spark, d) -> DataFrame:
    return resample_bars(_line_ticks(spark, d, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))), "1d", KEY, "px", "l_quantity", "l_shipdate")


def event_bars(spark, d, timeframe: str) -> DataFrame:
    ticks = read(spark, d, "events").filter("value > 0").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("px"), F.lit(1.0).alias("qty"))
    return resample_bars(ticks, timeframe, ["ts", "event_id"])


def arrivals(spark, d) -> DataFrame:
    """Event ticks in a scrambled order of arrival, every 20th of them twice."""
    at = read(spark, d, "events").filter("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").alias("bar_ts"), ((F.col("event_id") * 7919) % 1000003 * 10).alias("arrival_seq"), F.col("value").alias("px"), "event_id")
    again = at.filter("event_id % 20 = 0").withColumn("arrival_seq", F.col("arrival_seq") + 1)
    return at.unionByName(again).drop("event_id")


def funding(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").filter("dayofyear(l_shipdate) % 3 = 0")
    return rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ts")).agg((F.avg("l_discount") - 0.05).alias("rate"))


def caps(spark, d) -> DataFrame:
    month = F.trunc("l_shipdate", "month").cast("timestamp_ntz")
    return read(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), month.alias("snapshot_ts")).agg(F.round(F.sum("l_extendedprice"), 2).alias("cap"))


def fills(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        (F.col("o_custkey") % 10).alias("account"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), k.alias("seq"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (1 + k % 5).cast("double").alias("qty"), (100 + F.col("o_totalprice") / 1000).alias("price"), F.lit(1.0).alias("leverage"),
    )


_TICK = ", ".join(KEY)


def _bars_sql(symbol: str) -> str:
    return f"""SELECT symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS bar_ts, arg_min(px, row({_TICK})) AS open, max(px) AS high, min(px) AS low,
    arg_max(px, row({_TICK})) AS close, sum(l_quantity) AS volume
    FROM (SELECT {symbol} AS symbol, l_extendedprice / l_quantity AS px, {_TICK} FROM lineitem) WHERE px > 0 GROUP BY 1, 2"""


def _event_sql(ms: int) -> str:
    return f"""SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // {ms * 1000}) * {ms * 1000}) AS bar_ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY 1, 2"""


#: Bodies of common table expressions.
SQL = {
    "bars": _bars_sql("concat(l_returnflag, l_linestatus)"),
    "wbars": _bars_sql("concat('S', l_suppkey)"),
    "hbars": _event_sql(3_600_000),
    "ebars": _event_sql(28_800_000),
    "arrivals": """SELECT symbol, bar_ts, arrival_seq + r AS arrival_seq, px FROM (SELECT event_type AS symbol, ts AS bar_ts, (event_id * 7919) % 1000003 * 10 AS arrival_seq, value AS px, event_id FROM events WHERE value > 0), range(2) AS t(r) WHERE r = 0 OR event_id % 20 = 0""",
    "funding": "SELECT concat(l_returnflag, l_linestatus) AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_discount) - 0.05 AS rate FROM lineitem WHERE dayofyear(l_shipdate) % 3 = 0 GROUP BY 1, 2",
    "caps": "SELECT concat('S', l_suppkey) AS symbol, date_trunc('month', l_shipdate)::TIMESTAMP AS snapshot_ts, round(sum(l_extendedprice), 2) AS cap FROM lineitem GROUP BY 1, 2",
    "fills": "SELECT o_custkey % 10 AS account, o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (1 + o_orderkey % 5)::DOUBLE AS qty, 100 + o_totalprice / 1000 AS price, 1.0::DOUBLE AS leverage FROM orders",
    "rets": "SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS log_ret, CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)",
}
NEEDS = {"rets": ["bars"]}


def with_tables(names: str, body: str) -> str:
    """body after the common table expressions of these names."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
