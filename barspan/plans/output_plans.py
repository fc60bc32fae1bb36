"""Queries on outputs that are read back, lineage, readiness, and history that goes on live."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions.scalars import UNIT_MS
from barspan.operators import divided as D
from barspan.operators import features as E
from barspan.operators import forecast as I
from barspan.operators import grid as G
from barspan.operators import monitor as L
from barspan.operators import performance as K
from barspan.operators import portfolio as H
from barspan.operators import risk as V
from barspan.operators import universe as U
from barspan.operators.divided_scores import winsor_scores
from barspan.operators.tiles import covariance_tiles, symbol_numbers, tile_pairs
from barspan.plans import bars_plans as B
from barspan.plans import fixtures as X
from barspan.plans import portfolio_plans as P
from barspan.plans.bars_plans import r, with_tables
from barspan.sources import readers as A
from barspan.sources.scratch import scratch_path, stored
from barspan.streaming import bars as M
from barspan.streaming.features import feature_updates, live_features
from barspan.streaming.stateful import after_history, in_order

QUERIES, SQL = {}, {}
_W = "PARTITION BY symbol ORDER BY bar_ts"


def query(name: str, tables: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(tables, sql) if tables else sql
        return f

    return add


# A: defaults and sinks
@query("a15_default_filters", sql="""SELECT symbol, CASE symbol WHEN 'BTCUSDT' THEN 0.0001 WHEN 'ETHUSDT' THEN 0.0001 WHEN 'BNBUSDT' THEN 0.01 WHEN 'XRPUSDT' THEN 1 WHEN 'SOLUSDT' THEN 0.01 ELSE 0 END::DOUBLE AS step_size,
CASE symbol WHEN 'BTCUSDT' THEN 0.001 WHEN 'ETHUSDT' THEN 0.01 WHEN 'BNBUSDT' THEN 0.1 WHEN 'XRPUSDT' THEN 1 WHEN 'SOLUSDT' THEN 0.1 ELSE 0 END::DOUBLE AS min_qty, 5.0::DOUBLE AS min_notional
FROM (SELECT concat(list_extract(['BTC', 'ETH', 'BNB', 'XRP', 'SOL', 'ADA'], 1 + s_suppkey % 6), CASE WHEN s_suppkey % 4 = 0 THEN 'EUR' ELSE 'USDT' END) AS symbol FROM supplier)""")
def _(s, d):
    k = F.col("s_suppkey")
    coin = F.element_at(F.array(*map(F.lit, ("BTC", "ETH", "BNB", "XRP", "SOL", "ADA"))), (1 + k % 6).cast("int"))
    symbols = X.read(s, d, "supplier").select(F.concat(coin, F.when(k % 4 == 0, "EUR").otherwise("USDT")).alias("symbol"))
    return A.default_symbol_filters(symbols)


_SERIES = f"{P._MOM} {P._CHG}, {P._COST}, {P._TURN}, {P._COV}, dg AS (SELECT bar_ts, sqrt(sum(x)) AS cov_turnover FROM (SELECT bar_ts, power(cov - lag(cov) OVER (PARTITION BY sym_i, sym_j ORDER BY bar_ts), 2) * CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END AS x FROM c250) GROUP BY bar_ts)"


@query("a17_risk_series", "rets", f""", {_SERIES} SELECT strategy_id, epoch_us(bar_ts) // 1000 AS ts, round(cov_turnover, 6) AS cov_turnover, round(turnover, 8) AS turnover, round(fee_cost + slippage_cost, 6) AS expected_cost,
round((fee_cost + slippage_cost) / 10000 * 1e4, 6) AS expected_cost_bp, round(fee_cost, 6) AS expected_fee, round(slippage_cost, 6) AS expected_slippage FROM tu JOIN co USING (strategy_id, bar_ts) LEFT JOIN dg USING (bar_ts)""")
def _(s, d):
    path = scratch_path(s, "risk-series")
    series = L.risk_series(V.cov_turnover(V.rolling_covariance(P.rets(s, d))), H.expected_costs(P.changes(s, d), 10_000.0), H.turnover(P.weights(s, d)))
    A.write_records(series, path)
    back = s.read.schema(series.schema).json(path)
    costs = [r(c, 6) for c in ("expected_cost", "expected_cost_bp", "expected_fee", "expected_slippage")]
    return back.select("strategy_id", "ts", F.round("risk_diag.cov_turnover", 6).alias("cov_turnover"), r("turnover"), *costs)


@query("a18_metrics_csv", "", P.SQL["k13_summary_long"])
def _(s, d):
    path = scratch_path(s, "metrics")
    A.write_metrics(K.long_metrics(K.performance_summary(P.equity(s, d), "1d", 10_000.0)), path)
    return A.read_metrics(s, path).select("strategy_id", "metric", r("value", 5))


@query("a19_equity_csv", "rets", P._EQ + " SELECT strategy_id, bar_ts, round(nav, 4) AS nav FROM eq")
def _(s, d):
    path = scratch_path(s, "equity")
    A.write_equity(P.equity(s, d), path)
    return A.read_equity(s, path).select("strategy_id", "bar_ts", r("nav", 4))


@query("a19_predictions_csv", "rets", f", {P._PRED} SELECT symbol, epoch_us(ts) // 1000 AS timestamp_ms, round(y_pred_logret, 8) AS y_pred_logret, round(y_true_logret, 8) AS y_true_logret FROM pr")
def _(s, d):
    path = scratch_path(s, "predictions-out")
    A.write_predictions(P.predictions(s, d), path)
    return A.read_predictions(s, path).select("symbol", "timestamp_ms", r("y_pred_logret"), r("y_true_logret"))


@query("a19_step_metrics", "", P.SQL["i08_fold_metrics"])
def _(s, d):
    path = scratch_path(s, "step-metrics")
    m = I.forecast_metrics(P.predictions(s, d), "symbol", "step")
    A.write_records(m, path)
    return s.read.schema(m.schema).json(path).select("symbol", "step", "n", *[r(c) for c in ("mse", "rmse", "mae", "ic_pearson", "ic_spearman", "sign_accuracy")])


# C: membership
@query("c04_in_universe", "wbars caps", f", {B._RANKS} SELECT symbol, bar_ts, round(close, 8) AS close FROM wbars WHERE symbol IN (SELECT symbol FROM ranks WHERE rank <= 20)")
def _(s, d):
    top = U.cap_ranks(X.caps(s, d)).filter("rank <= 20").select(F.lower("symbol").alias("symbol"))
    return G.in_universe(X.wide_bars(s, d), top).select("symbol", "bar_ts", r("close"))


# E: one more bar
@query("e16_feature_updates", "rets funding", f"{B._FEATURE_FRAME} WHERE raw.bar_ts >= TIMESTAMP '1998-01-01'")
def _(s, d):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    bars, rates = stored(X.daily_bars(s, d), "bars"), stored(X.funding(s, d), "rates")
    landed, out = scratch_path(s, "new-bars"), scratch_path(s, "feature-updates")
    schema = "symbol string, open double, high double, low double, close double, volume double, event_ts timestamp"
    new = bars.filter(F.col("bar_ts") >= cut).withColumn("event_ts", F.col("bar_ts").cast("timestamp")).drop("bar_ts")
    for late in (False, True):  # the stream stops and goes on from its checkpoint
        new.filter((F.col("event_ts") >= "1998-05-01") == late).write.mode("append").parquet(landed)
        stream = s.readStream.schema(schema).parquet(landed)
        feature_updates(stream, bars.filter(F.col("bar_ts") < cut), rates, out, f"{out}/state").awaitTermination()
    names = B._FEATURE_NAMES.split(", ")
    rows = s.read.schema("symbol string, bar_ts timestamp_ntz, " + ", ".join(f"{c} double" for c in names)).parquet(f"{out}/features")
    return rows.select("symbol", "bar_ts", *[r(c, 6) for c in names])


# E, G: the same values with each symbol divided into quarters of a year
@query("e08_rsi_innovation_divided", "", B.SQL["e08_rsi_innovation"])
def _(s, d):
    return D.rsi_innovation(X.daily_bars(s, d), "90d").select("symbol", "bar_ts", r("rsi_innov", 6))


@query("e10_atr_innovation_divided", "", B.SQL["e10_atr_innovation"])
def _(s, d):
    return D.atr_innovation(X.daily_bars(s, d), "90d").select("symbol", "bar_ts", r("atr_innov"))


@query("e14_winsor_z_divided", "", B.SQL["e14_winsor_z"])
def _(s, d):
    bars = X.daily_bars(s, d).select("symbol", "bar_ts", F.log1p("volume").alias("volume"))
    return bars.join(winsor_scores(bars, ["volume"], "90d", 256), ["symbol", "bar_ts"], "left").select("symbol", "bar_ts", F.round("z", 6).alias("volume_z"))


@query("g01_ewma_variance_divided", "", P.SQL["g01_ewma_variance"])
def _(s, d):
    return D.ewma_variance(P.rets(s, d), "90d").filter("ret is not null").select("symbol", "bar_ts", r("ewma_var"))


@query("g02_garch_variance_divided", "", P.SQL["g02_garch_variance"])
def _(s, d):
    return D.garch_variance(P.rets(s, d), "90d", size=256).filter("garch_var is not null").select("symbol", "bar_ts", r("garch_var"))


@query("g06_covariance_tiles", "rets", f", {P._COV} SELECT bar_ts, sym_i, sym_j, round(cov, 6) AS cov, n FROM c250")
def _(s, d):
    """Blocks of four symbols, so that six symbols make three tiles a bar."""
    rets = P.rets(s, d)
    numbers = symbol_numbers(rets)
    pairs = tile_pairs(covariance_tiles(rets, numbers, block=4), numbers, 4)
    return pairs.select("bar_ts", "sym_i", "sym_j", r("cov", 6), "n")


# G: readiness
@query("g14_model_ready", "rets", f", {P._COV} SELECT bar_ts, count(*) AS pairs, min(n) >= 60 AS ready FROM c250 GROUP BY bar_ts")
def _(s, d):
    return V.model_ready(V.rolling_covariance(P.rets(s, d)), 60)


# I: standardisers and lineage
@query("i04_standardizer_json", "", P.SQL["i03_fit_standardizer"])
def _(s, d):
    path = scratch_path(s, "standardizers")
    fit = I.fit_standardizer(I.assign_folds(P.sequences(s, d), P.folds(s)).filter("part = 'train'"))
    I.standardizer_to_json(fit).write.json(path)
    back = I.standardizer_from_json(s.read.schema("symbol string, fold int, payload string").json(path))
    return back.select("symbol", "fold", "feature", r("mean"), r("std"))


_SCORED = f""", {P._FOLDS}, v AS (SELECT symbol, bar_ts, log_ret, ln(1 + volume) AS lv, row_number() OVER ({_W}) AS n FROM rets WHERE log_ret IS NOT NULL),
q AS (SELECT a.symbol, a.bar_ts, a.n, fold, anchor, fold_end, bar_ts < anchor AS is_train, a.log_ret AS y FROM v a JOIN folds ON a.bar_ts < fold_end WHERE a.n > 8),
x AS (SELECT q.symbol, fold, avg(b.log_ret) AS m0, stddev_pop(b.log_ret) AS s0 FROM q JOIN v b ON b.symbol = q.symbol AND b.n BETWEEN q.n - 8 AND q.n - 1 WHERE is_train GROUP BY 1, 2),
t AS (SELECT symbol, fold, avg(y) AS my, stddev_pop(y) AS sy, min(bar_ts) AS train_start, max(bar_ts) AS train_end FROM q WHERE is_train GROUP BY 1, 2),
sc AS (SELECT q.symbol, q.fold, q.bar_ts, 0.1 * (p.log_ret - m0) / s0 AS z, my, sy, q.y, train_start, train_end, anchor, fold_end
FROM q JOIN x ON x.symbol = q.symbol AND x.fold = q.fold JOIN t ON t.symbol = q.symbol AND t.fold = q.fold JOIN v p ON p.symbol = q.symbol AND p.n = q.n - 1 WHERE NOT is_train)"""


def _scored(s, d):
    a = I.assign_folds(P.sequences(s, d), P.folds(s))
    train = a.filter("part = 'train'")
    models = {x: I.LastValue() for x in ("AF", "AO", "NF", "NO", "RF", "RO")}
    return I.score_windows(I.standardize(a.filter("part = 'test'"), I.fit_standardizer(train)), models), train


@query("i05_scored_predictions", "rets", f"{_SCORED} SELECT symbol, fold, bar_ts AS target_ts, round(z, 8) AS y_pred_std, round(z * sy + my, 8) AS y_pred_logret, round(y, 8) AS y_true_logret FROM sc")
def _(s, d):
    return _scored(s, d)[0].select("symbol", "fold", "target_ts", r("y_pred_std"), r("y_pred_logret"), r("y_true_logret"))


@query("i06_prediction_table", "rets", f"""{_SCORED} SELECT bar_ts AS ts, symbol, round(z * sy + my, 8) AS y_pred_logret, round(z, 8) AS y_pred_std, round(y, 8) AS y_true_logret, fold AS step, train_start, train_end, anchor AS pred_start, fold_end AS pred_end,
concat('models/', symbol, '/step_', lpad(fold::VARCHAR, 3, '0')) AS model_dir FROM sc""")
def _(s, d):
    table = I.prediction_table(*_scored(s, d), P.folds(s), "models")
    return table.withColumns({c: F.round(c, 8) for c in ("y_pred_logret", "y_pred_std", "y_true_logret")})


_LAST = f""", {P._FOLDS}, v AS (SELECT symbol, bar_ts, log_ret AS y, lag(log_ret) OVER w AS a, ln(1 + lag(volume) OVER w) AS b FROM rets WINDOW w AS ({_W})), w AS (SELECT * FROM v WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT symbol, fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM w JOIN folds ON bar_ts < anchor GROUP BY 1, 2),
f AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS ca, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS cb FROM m)"""


def _lagged(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("bar_ts")
    return P.rets(s, d).select("symbol", F.col("bar_ts").alias("target_ts"), F.lag("log_ret").over(w).alias("a"), F.log1p(F.lag("volume").over(w)).alias("b"), F.col("log_ret").alias("y"))


@query("i05_fit_linear", "rets", f"{_LAST} SELECT symbol, fold, n, round(my - ca * ma - cb * mb, 6) AS intercept, round(ca, 6) AS a, round(cb, 6) AS b FROM f")
def _(s, d):
    m = I.fit_linear(_lagged(s, d), ["a", "b"], "y", P.folds(s))
    return m.select("symbol", F.col("fold").cast("long").alias("fold"), "n", r("intercept", 6), F.round(F.col("coefficients")[0], 6).alias("a"), F.round(F.col("coefficients")[1], 6).alias("b"))


@query("i05_linear_predictions", "rets", f"{_LAST} SELECT w.symbol, folds.fold, bar_ts AS target_ts, round(my + ca * (a - ma) + cb * (b - mb), 6) AS y_pred FROM w JOIN folds ON bar_ts >= anchor AND bar_ts < fold_end JOIN f ON f.symbol = w.symbol AND f.fold = folds.fold")
def _(s, d):
    rows, folds = _lagged(s, d).dropna(), P.folds(s)
    test = I.assign_folds(rows, folds).filter("part = 'test'")
    made = I.predict_linear(test, I.fit_linear(rows, ["a", "b"], "y", folds), ["a", "b"])
    return made.select("symbol", F.col("fold").cast("long").alias("fold"), "target_ts", r("y_pred", 6))


# L: monitors
@query("l03_mean_rolling_error", "rets", f", {P._PRED}, e AS (SELECT symbol, ts, avg(power(y_pred_logret - y_true_logret, 2)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS e, count(*) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM pr) SELECT ts AS bar_ts, round(avg(e) FILTER (n >= 20), 8) AS avg_rolling_msep FROM e GROUP BY ts")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    square = F.pow(F.col("y_pred_logret") - F.col("y_true_logret"), F.lit(2.0))
    mean = F.when(F.count("*").over(w) >= 20, F.avg(square).over(w.rowsBetween(-19, 0))).otherwise(F.lit(float("nan")))
    rows = P.predictions(s, d).select(F.col("ts").alias("bar_ts"), "symbol", mean.alias("rolling_msep"))
    monitors = rows.groupBy("bar_ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("rolling_msep").alias("m")))).alias("forecast_monitor"))
    return L.mean_rolling_error(monitors).select("bar_ts", r("avg_rolling_msep"))


@query("l07_slow_forecasts", "rets", f", {P._PRED} SELECT symbol, ts, (100.0 * (day(ts) % 8))::DOUBLE AS latency_ms FROM pr WHERE 100 * (day(ts) % 8) > 500")
def _(s, d):
    p = P.predictions(s, d).withColumn("latency_ms", 100.0 * (F.dayofmonth("ts") % 8))
    return L.slow_forecasts(p).select("symbol", "ts", "latency_ms")


@query("m02_history_overlaps_live", "bars", "SELECT symbol, bar_ts, round(close, 7) AS close FROM bars")
def _(s, d):
    """The history reaches into 1996, and the stream starts with that year again: bars that come twice are told once."""
    bars = X.daily_bars(s, d)
    landed, out, state = (scratch_path(s, x) for x in ("overlap-landed", "overlap-bars", "overlap-state"))
    history = bars.filter("bar_ts < '1996-07-01'").select("symbol", "bar_ts", "close")
    live = bars.filter("bar_ts >= '1996-01-01'").select("symbol", "close", F.col("bar_ts").cast("timestamp").alias("event_ts"))
    for late in (False, True):
        live.filter(F.col("event_ts").between(*(("1997-05-01", "2100-01-01") if late else ("1996-01-01", "1997-06-30")))).write.mode("append").parquet(landed)
        new = M.run_available(after_history(s.readStream.schema(live.schema).parquet(landed), history), out, state)
    every = history.unionByName(new.select("symbol", F.col("event_ts").cast("timestamp_ntz").alias("bar_ts"), "close"))
    return every.select("symbol", "bar_ts", r("close", 7))


# M: all features live, history and continuation, late bars
_HOURS = with_tables("rets funding", B._FEATURE_FRAME).replace(X.SQL["bars"], X.SQL["hbars"])


@query("m06_live_features", "", _HOURS)
def _(s, d):
    """All eight features of hourly bars, none known before; the stream stops after half of them and goes on."""
    landed, out, state = (scratch_path(s, x) for x in ("live-hours", "live-hour-features", "live-hour-state"))
    bars = X.event_bars(s, d, "1h").withColumn("event_ts", F.col("bar_ts").cast("timestamp")).drop("bar_ts")
    names = B._FEATURE_NAMES.split(", ")
    for late in (False, True):
        bars.filter((F.dayofmonth("event_ts") > 15) == late).write.mode("append").parquet(landed)
        stream = s.readStream.schema(bars.schema).parquet(landed)
        made = M.run_available(live_features(stream), out, state)
    return made.select("symbol", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), *[r(c, 6) for c in names])


@query("m02_history_then_live", "bars", "SELECT symbol, bar_ts, round(close, 7) AS close FROM bars")
def _(s, d):
    """The newest bars of the past come in one load, later ones by a stream that stops and goes on from its checkpoint."""
    bars = X.daily_bars(s, d)
    landed, out, state = (scratch_path(s, x) for x in ("live-landed", "live-bars", "live-state"))
    wire = lambda b: A.encode_klines(b, "1d", UNIT_MS["d"]).select("symbol", "timeframe", F.to_json("k").alias("raw"))
    fields = ("symbol", "bar_ts", "open", "high", "low", "close", "volume")
    before, first, second = (bars.filter(f"year(bar_ts) {x}") for x in ("< 1996", "in (1996, 1997)", "> 1997"))
    A.decode_klines(wire(before)).select(*fields).write.parquet(out + "-history")
    for part in (first, second):
        wire(part).write.mode("append").json(landed)
        live = M.run_available(M.closed_only(M.stream_klines(s, landed)).select(*fields), out, state)
    every = s.read.schema(live.schema).parquet(out + "-history").unionByName(live)
    return every.select("symbol", "bar_ts", r("close", 7))


@query("m04_late_bars", "ebars", "SELECT symbol, bar_ts, close FROM ebars WHERE day(bar_ts) % 2 = 0 OR bar_ts > coalesce((SELECT max(e.bar_ts) FROM ebars e WHERE e.symbol = ebars.symbol AND day(e.bar_ts) % 2 = 0), TIMESTAMP '1900-01-01')")
def _(s, d):
    """Bars of odd days come after all those of even days; the strict way keeps what is later than the last of these."""
    landed, out, state = (scratch_path(s, x) for x in ("late-landed", "late-bars", "late-state"))
    bars = X.event_bars(s, d, "8h")
    for odd in (0, 1):
        part = bars.filter(F.dayofmonth("bar_ts") % 2 == odd).withColumn("event_ts", F.col("bar_ts").cast("timestamp")).drop("bar_ts")
        part.write.mode("append").parquet(landed)
        stream = s.readStream.schema("symbol string, open double, high double, low double, close double, volume double, event_ts timestamp").parquet(landed)
        kept = M.run_available(in_order(stream), out, state)
    return kept.select("symbol", F.col("event_ts").cast("timestamp_ntz").alias("bar_ts"), "close")
