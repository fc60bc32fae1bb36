"""Queries on scalars, filters, the bar grid, returns, features and universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import scalars as S
from barspan.operators import features as E
from barspan.operators import grid as G
from barspan.operators import returns as R
from barspan.operators import scan
from barspan.operators import universe as U
from barspan.plans import fixtures as X
from barspan.plans.fixtures import with_tables

QUERIES, SQL = {}, {}

def query(name: str, tables: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(tables, sql) if tables else sql
        return f

    return add


def r(c, n: int = 8):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


# B: scalar functions
@query("b01_normalize_symbol", sql="SELECT o_orderkey, upper(replace(o_orderpriority, '-', '/')) AS raw, replace(upper(replace(o_orderpriority, '-', '/')), '/', '') AS symbol FROM orders")
def _(s, d):
    raw = F.upper(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("/")))
    return X.read(s, d, "orders").select("o_orderkey", raw.alias("raw"), S.normalize_symbol(raw).alias("symbol"))


@query("b02_timeframe_ms", sql="SELECT tf, n::BIGINT * CASE u WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 ELSE 604800000 END AS ms, count(*) AS rows FROM (SELECT concat(1 + l_linenumber, list_extract(['m', 'h', 'd', 'w'], 1 + l_linenumber % 4)) AS tf, 1 + l_linenumber AS n, list_extract(['m', 'h', 'd', 'w'], 1 + l_linenumber % 4) AS u FROM lineitem) GROUP BY ALL")
def _(s, d):
    n = F.col("l_linenumber")
    tf = F.concat((1 + n).cast("string"), F.element_at(F.array(*map(F.lit, "mhdw")), 1 + n % 4))
    return X.read(s, d, "lineitem").select(tf.alias("tf")).groupBy("tf").agg(F.count("*").alias("rows")).select("tf", S.timeframe_ms_col(F.col("tf")).alias("ms"), "rows")


@query("b03_bars_per_day", "bars", "SELECT symbol, count(*) AS bars, count(*) / 3 AS days FROM bars GROUP BY symbol")
def _(s, d):
    return X.daily_bars(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), (F.count("*") / S.bars_per_day("8h")).alias("days"))


@query("b04_align", sql="SELECT event_id, make_timestamp((epoch_us(ts) // 28800000000) * 28800000000) AS grid_ts, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS grid_5m FROM events")
def _(s, d):
    return X.read(s, d, "events").select("event_id", S.align(F.col("ts"), "8h").alias("grid_ts"), S.align(F.col("ts"), "5m").alias("grid_5m"))


@query("b05_unix_millis", sql="SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(ts AS DATE) AS day FROM events")
def _(s, d):
    return X.read(s, d, "events").select("event_id", S.unix_millis(F.col("ts")).alias("ms"), F.to_date("ts").alias("day"))


@query("b07_finite", sql="SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events")
def _(s, d):
    k = F.col("event_id")
    odd = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return X.read(s, d, "events").select("event_id", S.finite(odd).alias("value"))


@query("b10_scalar_prices", "rets", "SELECT symbol, bar_ts, round(exp(log_ret) - 1, 8) AS simple, round(ln(1 + volume), 8) AS log_volume, round(coalesce((close - open) / nullif(open, 0) * 100, 0), 8) AS change_pct, round(CASE WHEN log_ret IS NOT NULL THEN least(greatest(log_ret, -0.1), 0.1) END, 8) AS clipped FROM rets")
def _(s, d):
    t = R.with_returns(X.daily_bars(s, d))
    return t.select("symbol", "bar_ts", r(S.to_simple(F.col("log_ret"))).alias("simple"), r(F.log1p("volume")).alias("log_volume"), r(S.candle_change_pct(F.col("open"), F.col("close"))).alias("change_pct"), r(S.clip(F.col("log_ret"), -0.1, 0.1)).alias("clipped"))


@query("b14_trade_scalars", "fills", "SELECT seq, round(floor((qty * 0.37 + 1e-12) / 0.25) * 0.25, 8) AS stepped, round(price * (1 + 5 / 1e4 * CASE WHEN side = 'buy' THEN 1 ELSE -1 END), 6) AS slipped, round(abs(qty * price) * 0.0004, 6) AS fee, sign(qty - 3) = sign(price - 200) AS same_sign FROM fills")
def _(s, d):
    q, p = F.col("qty"), F.col("price")
    return X.fills(s, d).select("seq", r(S.floor_to_step(q * 0.37, F.lit(0.25))).alias("stepped"), r(S.slipped_price(p, F.col("side"), F.lit(5.0)), 6).alias("slipped"), r(S.fee(q * p, 0.0004), 6).alias("fee"), S.same_sign(q - 3, p - 200).alias("same_sign"))


@query("b17_override_or_default", "fills", "SELECT seq, coalesce(o.bps, 5.0)::DOUBLE AS bps FROM fills LEFT JOIN (VALUES ('1-URGENT', 2.0), ('5-LOW', 9.0)) AS o(symbol, bps) USING (symbol)")
def _(s, d):
    over = s.createDataFrame([("1-URGENT", 2.0), ("5-LOW", 9.0)], "symbol string, bps double")  # a fixed table of two
    return X.fills(s, d).join(F.broadcast(over), "symbol", "left").select("seq", F.coalesce("bps", F.lit(5.0)).alias("bps"))


@query("b20_array_tail", "bars", "SELECT symbol, list_extract(l, -1) AS last_volume, list_slice(l, -3, -1) AS last_three FROM (SELECT symbol, list(volume ORDER BY bar_ts) AS l FROM bars GROUP BY symbol)")
def _(s, d):
    v = X.daily_bars(s, d).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("bar_ts", "volume"))), lambda x: x["volume"]).alias("l"))
    return v.select("symbol", F.element_at("l", -1).alias("last_volume"), F.slice("l", -3, 3).alias("last_three"))


# C: filters
@query("c01_closed_bars", "ebars", "SELECT symbol, bar_ts, close FROM ebars WHERE bar_ts + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-20 05:00:00'")
def _(s, d):
    return G.closed_bars(X.event_bars(s, d, "8h"), "2024-01-20 05:00:00", "8h").select("symbol", "bar_ts", "close")


@query("c02_closed_history", "ebars", "SELECT symbol, bar_ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS n FROM ebars WHERE bar_ts < TIMESTAMP '2024-01-20 00:00:00') WHERE n <= 10")
def _(s, d):
    return G.closed_history(X.event_bars(s, d, "8h"), "2024-01-20 05:00:00", "8h", 10).select("symbol", "bar_ts", "close")


@query("c03_window_filter", "bars", "SELECT symbol, bar_ts, close FROM bars WHERE bar_ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND symbol IN ('AF', 'RF')")
def _(s, d):
    t = F.col("bar_ts")
    universe = s.createDataFrame([("AF",), ("RF",)], "symbol string")
    return X.daily_bars(s, d).filter(t.between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).join(universe, "symbol", "left_semi").select("symbol", "bar_ts", "close")


@query("c05_ready_symbols", "hbars", """SELECT symbol, n FROM (SELECT symbol, count(*) AS n, count(*) - 1 = (epoch_ms(max(bar_ts)) - epoch_ms(min(bar_ts))) / 3600000 AS whole
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k FROM hbars) WHERE k <= 12 GROUP BY symbol) WHERE n = 12 AND whole""")
def _(s, d):
    last = G.last_n(X.event_bars(s, d, "1h"), 12)
    full = last.groupBy("symbol").agg(F.count("*").alias("n")).filter("n = 12")
    return full.join(G.missing_bars(last, "1h"), "symbol", "left_anti").select("symbol", "n")


@query("c09_dollar_guard", "bars", "SELECT count(*) AS n, count(DISTINCT symbol) AS symbols FROM bars WHERE close > 0 AND volume IS NOT NULL")
def _(s, d):
    return X.daily_bars(s, d).filter("close > 0 and volume is not null").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


# D: grid
@query("d00_resample_daily", "bars", "SELECT symbol, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM bars")
def _(s, d):
    return X.daily_bars(s, d).select("symbol", "bar_ts", r("open"), r("high"), r("low"), r("close"), "volume")


@query("d00_resample_wide", "wbars", "SELECT symbol, bar_ts, round(open, 8) AS open, round(close, 8) AS close, volume FROM wbars")
def _(s, d):
    return X.wide_bars(s, d).select("symbol", "bar_ts", r("open"), r("close"), "volume")


@query("d00_resample_8h", "ebars", "SELECT * FROM ebars")
def _(s, d):
    return X.event_bars(s, d, "8h")


_GRID = "make_timestamp((epoch_us(bar_ts) // 28800000000) * 28800000000)"


@query("d01_first_per_step", "arrivals", f"SELECT symbol, bar_ts, arrival_seq, px FROM (SELECT symbol, {_GRID} AS bar_ts, arrival_seq, px, row_number() OVER (PARTITION BY symbol, {_GRID} ORDER BY arrival_seq) AS n FROM arrivals) WHERE n = 1")
def _(s, d):
    return G.first_per_step(X.arrivals(s, d), "8h")


@query("d02_drop_out_of_order", "arrivals", "SELECT symbol, bar_ts, arrival_seq, px FROM (SELECT *, max(bar_ts) OVER (PARTITION BY symbol ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM arrivals) WHERE m IS NULL OR bar_ts > m")
def _(s, d):
    return G.drop_out_of_order(X.arrivals(s, d))


@query("d03_distinct_bars", "arrivals", "SELECT symbol, count(DISTINCT bar_ts) AS n FROM arrivals GROUP BY symbol")
def _(s, d):
    return X.arrivals(s, d).dropDuplicates(["symbol", "bar_ts"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("d04_seen_before", "arrivals", f"SELECT symbol, {_GRID} AS bar_ts, arrival_seq, px, row_number() OVER (PARTITION BY {_GRID} ORDER BY arrival_seq) > 1 AS seen_before FROM arrivals")
def _(s, d):
    return G.seen_before(X.arrivals(s, d).withColumn("bar_ts", S.align(F.col("bar_ts"), "8h")))


_MISSING = "SELECT symbol, unnest(generate_series(prev + INTERVAL 1 HOUR, bar_ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bar_ts FROM (SELECT symbol, bar_ts, lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS prev FROM hbars) WHERE bar_ts > prev + INTERVAL 1 HOUR"


@query("d05_missing_bars", "hbars", _MISSING)
def _(s, d):
    return G.missing_bars(X.event_bars(s, d, "1h"), "1h")


@query("d06_missing_from_grid", "hbars", _MISSING)
def _(s, d):
    return G.missing_from_grid(X.event_bars(s, d, "1h"), "1h")


@query("d07_last_n", "bars", "SELECT symbol, bar_ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS n FROM bars) WHERE n <= 5")
def _(s, d):
    return G.last_n(X.daily_bars(s, d), 5).select("symbol", "bar_ts", "close")


@query("d08_latest_bars", "bars", "SELECT symbol, max(bar_ts) AS bar_ts, arg_max(close, bar_ts) AS close FROM bars WHERE bar_ts <= TIMESTAMP '1998-01-01' GROUP BY symbol")
def _(s, d):
    return G.latest_bars(X.daily_bars(s, d), "1998-01-01").select("symbol", "bar_ts", "close")


@query("d09_tracked_keys", "bars", "SELECT DISTINCT symbol, '1d' AS timeframe FROM bars")
def _(s, d):
    return X.daily_bars(s, d).select("symbol", F.lit("1d").alias("timeframe")).distinct()


@query("d10_quality_report", "hbars", f"SELECT s.symbol, coalesce(m.n, 0) AS missing, 0::BIGINT AS outliers FROM (SELECT DISTINCT symbol FROM hbars) s LEFT JOIN (SELECT symbol, count(*) AS n FROM ({_MISSING}) GROUP BY symbol) m ON s.symbol = m.symbol")
def _(s, d):
    return G.quality_report(X.event_bars(s, d, "1h"), "1h")


@query("d11_clock", "hbars", "SELECT DISTINCT bar_ts FROM hbars")
def _(s, d):
    return G.clock(X.event_bars(s, d, "1h"))


@query("d12_locf", "hbars", "SELECT symbol, bar_ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts) AS close FROM (SELECT s.symbol, c.bar_ts, h.close FROM (SELECT symbol, min(bar_ts) AS lo FROM hbars GROUP BY symbol) s JOIN (SELECT DISTINCT bar_ts FROM hbars) c ON c.bar_ts >= s.lo LEFT JOIN hbars h ON h.symbol = s.symbol AND h.bar_ts = c.bar_ts)")
def _(s, d):
    b = X.event_bars(s, d, "1h")
    return G.locf(b, G.clock(b))


@query("d13_warmup_split", "bars", "SELECT symbol, CASE WHEN bar_ts < TIMESTAMP '1998-01-01' THEN 'warmup' ELSE 'test' END AS phase, count(*) AS n FROM bars GROUP BY ALL")
def _(s, d):
    return G.warmup_split(X.daily_bars(s, d), "1998-01-01").groupBy("symbol", "phase").agg(F.count("*").alias("n"))


@query("d14_history_scan", "bars", "SELECT symbol, min(bar_ts) AS first_ts, count(*) AS n FROM bars WHERE bar_ts >= TIMESTAMP '1998-06-01' - INTERVAL 94 DAY GROUP BY symbol")
def _(s, d):
    start = F.lit("1998-06-01").cast("timestamp_ntz") - F.expr(f"INTERVAL {G.history_days(64, '1d')} DAY")
    return X.daily_bars(s, d).filter(F.col("bar_ts") >= start).groupBy("symbol").agg(F.min("bar_ts").alias("first_ts"), F.count("*").alias("n"))


@query("d15_buffer_sizes", "rets", "SELECT symbol, count(close) AS prices, count(ret) AS returns, count(log_ret) AS log_returns FROM rets GROUP BY symbol")
def _(s, d):
    return R.buffer_sizes(R.with_returns(X.daily_bars(s, d)))


# E: returns and features
@query("e01_returns", "rets", "SELECT symbol, bar_ts, round(ret, 8) AS ret, round(log_ret, 8) AS log_ret FROM rets")
def _(s, d):
    return R.with_returns(X.daily_bars(s, d)).select("symbol", "bar_ts", r("ret"), r("log_ret"))


@query("e02_tails", "rets", "SELECT symbol, list(round(ret, 8) ORDER BY bar_ts) AS rets, max(bar_ts) AS last_ts, round(arg_max(ret, bar_ts), 8) AS last_ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS n FROM rets WHERE ret IS NOT NULL) WHERE n <= 15 GROUP BY symbol")
def _(s, d):
    return R.tails(R.with_returns(X.daily_bars(s, d)), 15).select("symbol", F.transform("rets", lambda x: F.round(x, 8)).alias("rets"), "last_ts", r("last_ret"))


@query("e03_matrix_by_position", "rets", "SELECT n - 1 AS pos, symbol, round(ret, 8) AS ret FROM (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS n, count(*) OVER (PARTITION BY symbol) AS c FROM rets WHERE ret IS NOT NULL) WHERE n <= 180 AND c >= 180")
def _(s, d):
    return R.return_matrix(R.with_returns(X.daily_bars(s, d)), 180, "position").select("pos", "symbol", r("ret"))


@query("e03_matrix_by_time", "rets", """, v AS (SELECT symbol, bar_ts, ret, count(*) OVER (PARTITION BY symbol) AS c FROM rets WHERE ret IS NOT NULL),
t AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts DESC) - 1 AS pos FROM v WHERE c >= 180 GROUP BY bar_ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM v WHERE c >= 180))
SELECT pos, symbol, round(ret, 8) AS ret FROM v JOIN t USING (bar_ts) WHERE c >= 180 AND pos < 180""")
def _(s, d):
    return R.return_matrix(R.with_returns(X.daily_bars(s, d)), 180).select("pos", "symbol", r("ret"))


@query("e05_tsmom", "rets", """SELECT symbol, bar_ts, round(sum(log_ret) OVER w3 / CASE WHEN sum(log_ret * log_ret) OVER w3 = 0 THEN 1e-9 ELSE sqrt(sum(log_ret * log_ret) OVER w3) END, 8) AS mom_3,
round(sum(log_ret) OVER w15 / CASE WHEN sum(log_ret * log_ret) OVER w15 = 0 THEN 1e-9 ELSE sqrt(sum(log_ret * log_ret) OVER w15) END, 8) AS mom_15
FROM rets WINDOW w3 AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w15 AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return R.with_returns(X.daily_bars(s, d)).select("symbol", "bar_ts", r(E.tsmom("log_ret", 3)).alias("mom_3"), r(E.tsmom("log_ret", 15)).alias("mom_15"))


def ema_sql(source: str, x: str, span: int, out: str) -> str:
    """Closed form of the exponential average over rows of `source` whose x isn't null, as a subquery with column out."""
    a, dd = f"(2.0::DOUBLE / {span + 1})", f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"""SELECT *, power({dd}, i) * sum(CASE WHEN i = 0 THEN {x} ELSE {x} * {a} END * power({dd}, -i)) OVER (PARTITION BY symbol ORDER BY bar_ts) AS {out}
FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1)::DOUBLE AS i FROM ({source}) WHERE {x} IS NOT NULL)"""


def wilder_sql(source: str, x: str, n: int, out: str) -> str:
    dd = f"(1 - 1.0::DOUBLE / {n})"
    return f"""SELECT * EXCLUDE (i, seed), CASE WHEN i >= 0 THEN power({dd}, i) * sum(CASE WHEN i = 0 THEN seed WHEN i > 0 THEN {x} / {n} ELSE 0 END * power({dd}, -greatest(i, 0))) OVER (PARTITION BY symbol ORDER BY bar_ts) END AS {out}
FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - {n})::DOUBLE AS i, avg({x}) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seed FROM ({source}) WHERE {x} IS NOT NULL)"""


_TR = "SELECT symbol, bar_ts, close, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)"
_MOVES = "SELECT symbol, bar_ts, k, greatest(x, 0) AS up, greatest(-x, 0) AS down FROM (SELECT symbol, bar_ts, close - lag(close) OVER w AS x, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) WHERE x IS NOT NULL"
_RSI = f"SELECT symbol, bar_ts, k, CASE WHEN ad > 1e-300 THEN 100 - 100 / (1 + au / ad) WHEN au > 0 THEN 100 WHEN au = 0 THEN 50 END AS rsi FROM ({wilder_sql(wilder_sql(_MOVES, 'up', 12, 'au'), 'down', 12, 'ad')})"


@query("e06_wilder", "bars", f"SELECT symbol, bar_ts, round(atr, 8) AS atr FROM ({wilder_sql(_TR, 'tr', 14, 'atr')})")
def _(s, d):
    return scan.wilder(X.daily_bars(s, d).withColumn("tr", E.true_range()), "tr", 14, "atr").select("symbol", "bar_ts", r("atr"))


@query("e07_rsi", "bars", f"SELECT b.symbol, b.bar_ts, round(rsi, 6) AS rsi FROM bars b LEFT JOIN ({_RSI}) x ON b.symbol = x.symbol AND b.bar_ts = x.bar_ts")
def _(s, d):
    return E.with_rsi(X.daily_bars(s, d)).select("symbol", "bar_ts", r("rsi", 6))


@query("e08_rsi_innovation", "bars", f"SELECT b.symbol, b.bar_ts, round(CASE WHEN k >= 20 THEN rsi - e END, 6) AS rsi_innov FROM bars b LEFT JOIN ({ema_sql(_RSI, 'rsi', 20, 'e')}) x ON b.symbol = x.symbol AND b.bar_ts = x.bar_ts")
def _(s, d):
    return E.with_rsi_innovation(X.daily_bars(s, d)).select("symbol", "bar_ts", r("rsi_innov", 6))


@query("e09_true_range", "bars", f"SELECT symbol, bar_ts, round(tr, 8) AS tr FROM ({_TR})")
def _(s, d):
    return X.daily_bars(s, d).select("symbol", "bar_ts", r(E.true_range()).alias("tr"))


_ATR = ema_sql(f"SELECT symbol, bar_ts, k, atr / close AS pct FROM ({wilder_sql(_TR, 'tr', 14, 'atr')})", "pct", 20, "e")


@query("e10_atr_innovation", "bars", f"SELECT b.symbol, b.bar_ts, round(CASE WHEN k >= 20 THEN pct - e END, 8) AS atr_innov FROM bars b LEFT JOIN ({_ATR}) x ON b.symbol = x.symbol AND b.bar_ts = x.bar_ts")
def _(s, d):
    return E.with_atr_innovation(X.daily_bars(s, d)).select("symbol", "bar_ts", r("atr_innov"))


@query("e11_ema", "bars", f"SELECT symbol, bar_ts, round(e, 6) AS ema FROM ({ema_sql('SELECT symbol, bar_ts, close FROM bars', 'close', 20, 'e')})")
def _(s, d):
    return scan.ema(X.daily_bars(s, d), "close", 20, "ema").select("symbol", "bar_ts", r("ema", 6))


_OBV = "CASE WHEN lag(close) OVER w IS NOT NULL THEN coalesce(sign(close - lag(close) OVER w) * volume / nullif(avg(close * volume) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0), 0) END"


@query("e12_obv_tilt", "bars", f"SELECT symbol, bar_ts, round({_OBV}, 8) AS obv_tilt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)")
def _(s, d):
    return X.daily_bars(s, d).select("symbol", "bar_ts", r(E.obv_tilt()).alias("obv_tilt"))


@query("e13_funding_feature", "bars funding", "SELECT b.symbol, b.bar_ts, round(coalesce(f.rate, 0), 8) AS funding FROM bars b LEFT JOIN funding f ON b.symbol = f.symbol AND b.bar_ts = f.ts")
def _(s, d):
    return E.with_funding(X.daily_bars(s, d), X.funding(s, d)).select("symbol", "bar_ts", r("funding"))


@query("e14_winsor_z", "bars", """, h AS (SELECT symbol, bar_ts, ln(1 + volume) AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n FROM bars),
q AS (SELECT *, quantile_cont(x, 0.01) OVER w AS lo, quantile_cont(x, 0.99) OVER w AS hi, list(x) OVER w AS l FROM h WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, list_avg(list_transform(l, lambda v: least(greatest(v, lo), hi))) AS mean, list_stddev_pop(list_transform(l, lambda v: least(greatest(v, lo), hi))) AS sd FROM q WHERE n >= 200)
SELECT h.symbol, h.bar_ts, round((least(greatest(h.x, lo), hi) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS volume_z FROM h LEFT JOIN m ON h.symbol = m.symbol AND h.bar_ts = m.bar_ts""")
def _(s, d):
    b = X.daily_bars(s, d).withColumn("volume", F.log1p("volume"))
    return E.winsor_z(b.select("symbol", "bar_ts", "volume"), ["volume"]).select("symbol", "bar_ts", r("volume_z", 6))


def _mom_sql(k: int) -> str:
    return f"sum(log_ret) OVER w{k} / CASE WHEN sum(log_ret * log_ret) OVER w{k} = 0 THEN 1e-9 ELSE sqrt(sum(log_ret * log_ret) OVER w{k}) END AS mom_{k}"


_FEATURE_NAMES = "log_return, log_volume, mom_3, mom_15, rsi_innov, atr_innov, obv_tilt, funding"
_RAW = f"""raw AS (SELECT b.symbol, b.bar_ts, b.log_ret AS log_return, ln(1 + b.volume) AS log_volume, b.mom_3, b.mom_15, CASE WHEN ri.k >= 20 THEN ri.rsi - ri.e END AS rsi_innov,
CASE WHEN a.k >= 20 THEN a.pct - a.e END AS atr_innov, o.obv AS obv_tilt, coalesce(f.rate, 0) AS funding
FROM (SELECT *, {_mom_sql(3)}, {_mom_sql(15)} FROM rets WINDOW w3 AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w15 AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) b
LEFT JOIN ({ema_sql(_RSI, 'rsi', 20, 'e')}) ri ON b.symbol = ri.symbol AND b.bar_ts = ri.bar_ts LEFT JOIN ({_ATR}) a ON b.symbol = a.symbol AND b.bar_ts = a.bar_ts
LEFT JOIN (SELECT symbol, bar_ts, {_OBV} AS obv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) o ON b.symbol = o.symbol AND b.bar_ts = o.bar_ts LEFT JOIN funding f ON b.symbol = f.symbol AND b.bar_ts = f.ts)"""
_DIGITS = {"rsi_innov": 6}


def _rounded_sql(digits: dict[str, int], n: int = 8) -> str:
    return ", ".join(f"round({c}, {digits.get(c, n)}) AS {c}" for c in _FEATURE_NAMES.split(", "))


@query("e15_raw_features", "rets funding", f", {_RAW} SELECT symbol, bar_ts, {_rounded_sql(_DIGITS)} FROM raw")
def _(s, d):
    return E.raw_features(X.daily_bars(s, d), X.funding(s, d)).select("symbol", "bar_ts", *[r(c, _DIGITS.get(c, 8)) for c in _FEATURE_NAMES.split(", ")])


# All but log_return and log_volume are scored against their history: percentiles of it, then moments of what they clip.
_SCALED = [c for c in _FEATURE_NAMES.split(", ") if c not in ("log_return", "log_volume")]


_FEATURE_FRAME = f""", {_RAW}, u AS (UNPIVOT raw ON {', '.join(_SCALED)} INTO NAME feature VALUE x),
h AS (SELECT symbol, bar_ts, feature, x, row_number() OVER (PARTITION BY symbol, feature ORDER BY bar_ts) AS n FROM u WHERE x IS NOT NULL),
q AS (SELECT *, quantile_cont(x, 0.01) OVER w AS lo, quantile_cont(x, 0.99) OVER w AS hi FROM h WINDOW w AS (PARTITION BY symbol, feature ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT q.symbol, q.bar_ts, q.feature, any_value(least(greatest(q.x, q.lo), q.hi)) AS c, avg(least(greatest(o.x, q.lo), q.hi)) AS mean, stddev_pop(least(greatest(o.x, q.lo), q.hi)) AS sd
FROM q JOIN h o ON o.symbol = q.symbol AND o.feature = q.feature AND o.n <= q.n WHERE q.n >= 200 GROUP BY 1, 2, 3),
z AS (SELECT symbol, bar_ts, {', '.join(f"max((c - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END) FILTER (feature = '{c}') AS {c}" for c in _SCALED)} FROM m GROUP BY 1, 2)
SELECT raw.symbol, raw.bar_ts, round(raw.log_return, 6) AS log_return, round(raw.log_volume, 6) AS log_volume, {', '.join(f'round(z.{c}, 6) AS {c}' for c in _SCALED)} FROM raw LEFT JOIN z ON raw.symbol = z.symbol AND raw.bar_ts = z.bar_ts"""


@query("e17_feature_frame", "rets funding", _FEATURE_FRAME)
def _(s, d):
    return E.feature_frame(X.daily_bars(s, d), X.funding(s, d)).select("symbol", "bar_ts", *[r(c, 6) for c in _FEATURE_NAMES.split(", ")])


_W = ["log_return", "obv_tilt"]


def _two(s, d):
    return R.with_returns(X.daily_bars(s, d)).select("symbol", "bar_ts", F.col("log_ret").alias("log_return"), E.obv_tilt().alias("obv_tilt"))


_TWO = f"two AS (SELECT symbol, bar_ts, log_ret AS log_return, {_OBV} AS obv_tilt FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))"


@query("e18_feature_windows", "rets", f", {_TWO} SELECT symbol, bar_ts, size, total FROM (SELECT symbol, bar_ts, count(log_return + obv_tilt) OVER v AS size, round(sum(log_return) OVER v, 8) AS total FROM two WINDOW v AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) WHERE size = 16")
def _(s, d):
    w = E.feature_windows(_two(s, d), 16, _W)
    return w.select("symbol", "bar_ts", F.size("x").cast("long").alias("size"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])).alias("total"))


@query("e19_supervised_sequences", "rets", f", {_TWO} SELECT symbol, bar_ts AS target_ts, size, total, round(log_return, 8) AS y FROM (SELECT symbol, bar_ts, log_return, count(*) OVER v AS size, round(sum(obv_tilt) OVER v, 8) AS total FROM two WHERE log_return IS NOT NULL AND obv_tilt IS NOT NULL WINDOW v AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)) WHERE size = 16")
def _(s, d):
    q = E.supervised_sequences(_two(s, d), 16, _W)
    return q.select("symbol", "target_ts", F.size("x").cast("long").alias("size"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v[1])).alias("total"), r("y"))


@query("e20_feature_stats", "rets", f""", {_TWO}, v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS n, count(*) OVER (PARTITION BY symbol) AS c FROM two WHERE log_return IS NOT NULL AND obv_tilt IS NOT NULL),
x AS (SELECT a.symbol, b.log_return, b.obv_tilt FROM v a JOIN v b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 16 AND a.n - 1 WHERE a.n > 16),
u AS (UNPIVOT x ON log_return, obv_tilt INTO NAME feature VALUE v)
SELECT symbol, feature, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std, round(min(v), 8) AS min, round(max(v), 8) AS max, stddev_pop(v) = 0 AS constant FROM u GROUP BY ALL""")
def _(s, d):
    return E.feature_stats(E.supervised_sequences(_two(s, d), 16, _W), _W).select("symbol", "feature", r("mean"), r("std"), r("min"), r("max"), "constant")


# F: universe
_RANKS = "ranks AS (SELECT symbol, row_number() OVER (ORDER BY cap DESC, symbol) AS rank FROM caps WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM caps))"
_DAILY = "daily AS (SELECT symbol, bar_ts::DATE AS day, sum(close * volume) AS dollar_volume FROM wbars WHERE close > 0 AND volume IS NOT NULL GROUP BY 1, 2)"


@query("f01_cap_ranks", "caps", f", {_RANKS} SELECT * FROM ranks")
def _(s, d):
    return U.cap_ranks(X.caps(s, d))


@query("f01_cap_ranks_stale", "caps", "SELECT symbol, arg_max(rank, snapshot_ts) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts ORDER BY cap DESC, symbol) AS rank FROM caps) GROUP BY symbol")
def _(s, d):
    return U.cap_ranks(X.caps(s, d), keep_stale=True)


@query("f03_daily_dollar_volume", "wbars", f", {_DAILY} SELECT symbol, day, round(dollar_volume, 4) AS dollar_volume FROM daily")
def _(s, d):
    return U.daily_dollar_volume(X.wide_bars(s, d)).select("symbol", "day", r("dollar_volume", 4))


@query("f04_prune_days", "wbars", f", {_DAILY} SELECT symbol, count(*) AS n FROM daily WHERE day >= DATE '1998-06-01' - 30 GROUP BY symbol")
def _(s, d):
    return U.prune_days(U.daily_dollar_volume(X.wide_bars(s, d)), "1998-06-01", 30).groupBy("symbol").agg(F.count("*").alias("n"))


_MEDIAN = "medians AS (SELECT s.symbol, coalesce(median(dollar_volume), 0) AS median_volume FROM (SELECT DISTINCT symbol FROM wbars) s LEFT JOIN daily x ON s.symbol = x.symbol AND day BETWEEN DATE '1998-06-01' - 180 AND DATE '1998-06-01' GROUP BY s.symbol)"


def _medians(s, d):
    b = X.wide_bars(s, d)
    return U.median_volume(U.daily_dollar_volume(b), b.select("symbol").distinct(), "1998-06-01", 180)


@query("f05_median_volume", "wbars", f", {_DAILY}, {_MEDIAN} SELECT symbol, round(median_volume, 4) AS median_volume FROM medians")
def _(s, d):
    return _medians(s, d).select("symbol", r("median_volume", 4))


@query("f06_select_universe", "wbars caps", f", {_DAILY}, {_MEDIAN}, {_RANKS} SELECT symbol, rank FROM ranks JOIN medians USING (symbol) WHERE rank <= 30 AND median_volume >= 20000 ORDER BY rank LIMIT 30")
def _(s, d):
    return U.select_universe(U.cap_ranks(X.caps(s, d)), _medians(s, d), 30, 20000.0)


@query("f06_default_universe", "wbars caps", "SELECT * FROM (VALUES ('S1', 1), ('S2', 2)) AS t(symbol, rank) WHERE (SELECT count(*) FROM wbars) > 0")
def _(s, d):
    return U.select_universe(U.cap_ranks(X.caps(s, d)), _medians(s, d), 30, 1e15, ["S1", "S2"])


_BYDAY = "bd AS (SELECT day, symbol, rank FROM (SELECT symbol, day, quantile_cont(dollar_volume, 0.5) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS m FROM daily) JOIN ranks USING (symbol) WHERE m >= 20000 AND rank <= 30)"


@query("f07_universe_by_day", "wbars caps", f", {_DAILY}, {_RANKS}, {_BYDAY} SELECT day, symbol, rank FROM bd")
def _(s, d):
    return U.universe_by_day(U.cap_ranks(X.caps(s, d)), U.daily_dollar_volume(X.wide_bars(s, d)), 30, 20000.0, 30)


@query("f08_universe_changes", "wbars caps", f", {_DAILY}, {_RANKS}, {_BYDAY}, l AS (SELECT day, list(symbol ORDER BY rank, symbol) AS s FROM bd GROUP BY day) SELECT day, len(s)::BIGINT AS n, coalesce(s IS DISTINCT FROM lag(s) OVER (ORDER BY day), true) AS changed FROM l")
def _(s, d):
    by = U.universe_by_day(U.cap_ranks(X.caps(s, d)), U.daily_dollar_volume(X.wide_bars(s, d)), 30, 20000.0, 30)
    return U.universe_changes(by)
