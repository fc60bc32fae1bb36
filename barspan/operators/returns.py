"""Returns per bar, their tails, and aligned return matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import log_return, simple_return
from barspan.operators.grid import by_symbol, last_n


def with_returns(bars: DataFrame) -> DataFrame:
    """Add ret and log_ret against the previous bar; null where either price isn't positive."""
    prev = F.lag("close").over(by_symbol())
    return bars.withColumns({"ret": simple_return(F.col("close"), prev), "log_ret": log_return(F.col("close"), prev)})


def tails(returns: DataFrame, k: int) -> DataFrame:
    """The last k returns and closes of each symbol as arrays in time order, with the latest of each."""
    rows = last_n(returns.filter("ret is not null"), k)
    ordered = F.sort_array(F.collect_list(F.struct("bar_ts", "ret", "log_ret", "close")))
    s = rows.groupBy("symbol").agg(ordered.alias("s"))
    field = lambda name: F.transform("s", lambda x: x[name])
    return s.select("symbol", field("ret").alias("rets"), field("log_ret").alias("log_rets"), field("close").alias("closes"), F.element_at("s", -1)["bar_ts"].alias("last_ts"), F.element_at("s", -1)["ret"].alias("last_ret"))


def return_matrix(returns: DataFrame, window: int, align: str = "ts") -> DataFrame:
    """Long matrix (pos, symbol, ret) of symbols with at least `window` returns.

    align="ts" numbers the newest `window` times that all these symbols share, 0 the newest; align="position" numbers each
    symbol's own returns from its newest, so that gaps shift rows.
    """
    valid = returns.filter("ret is not null").select("symbol", "bar_ts", "ret")
    full = valid.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= window).select("symbol")
    rows = valid.join(full, "symbol")
    if align == "position":
        pos = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ts"))) - 1
        return rows.withColumn("pos", pos).filter(F.col("pos") < window).select("pos", "symbol", "ret")
    n_symbols = full.agg(F.count("*").alias("n_all"))
    # One row: the number of symbols.
    times = rows.groupBy("bar_ts").agg(F.count("*").alias("n")).join(F.broadcast(n_symbols), F.col("n") == F.col("n_all"))
    newest = times.orderBy(F.desc("bar_ts")).limit(window).select("bar_ts", (F.row_number().over(Window.orderBy(F.desc("bar_ts"))) - 1).alias("pos"))
    return rows.join(newest, "bar_ts").select("pos", "symbol", "ret")


def buffer_sizes(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(F.count("close").alias("prices"), F.count("ret").alias("returns"), F.count("log_ret").alias("log_returns"))
