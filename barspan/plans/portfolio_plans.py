"""Queries on risk, portfolios, forecasts, the ledger, performance and monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspan.operators import features as E
from barspan.operators import forecast as I
from barspan.operators import grid as G
from barspan.operators import ledger as J
from barspan.operators import monitor as L
from barspan.operators import performance as K
from barspan.operators import portfolio as H
from barspan.operators import returns as R
from barspan.operators import risk as V
from barspan.plans import fixtures as X
from barspan.plans.bars_plans import r, with_tables

QUERIES, SQL = {}, {}
_W = "PARTITION BY symbol ORDER BY bar_ts"


def query(name: str, tables: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(tables, sql) if tables else sql
        return f

    return add


def rets(s, d):
    return R.with_returns(X.daily_bars(s, d))


# G: risk
_VALID = "v AS (SELECT symbol, bar_ts, ret, (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts))::DOUBLE AS n FROM rets WHERE ret IS NOT NULL)"


def _ewma(body: str) -> str:
    return f""", {_VALID}, e AS (SELECT symbol, bar_ts, ret, CASE WHEN n >= 30 THEN greatest(1e-10, power(0.94::DOUBLE, n) * sum(CASE WHEN n = 30 THEN seed WHEN n > 30 THEN 0.06 * ret * ret ELSE 0 END * power(0.94::DOUBLE, -greatest(n, 30))) OVER ({_W})) END AS ewma_var
FROM (SELECT *, var_samp(ret) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seed FROM v)) {body}"""


@query("g01_ewma_variance", "rets", _ewma("SELECT symbol, bar_ts, round(ewma_var, 8) AS ewma_var FROM e"))
def _(s, d):
    return V.ewma_variance(rets(s, d)).filter("ret is not null").select("symbol", "bar_ts", r("ewma_var"))


_GARCH = f"""g AS (SELECT a.symbol, a.bar_ts, a.ret, power(0.9::DOUBLE, 60) * max(vs) + sum(power(0.9::DOUBLE, a.n - b.n) * (1e-6 + 0.05 * b.ret * b.ret)) AS garch_var
FROM (SELECT *, var_samp(ret) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vs FROM v) a JOIN v b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 59 AND a.n WHERE a.n >= 60 GROUP BY 1, 2, 3)"""


@query("g02_garch_variance", "rets", f", {_VALID}, {_GARCH} SELECT symbol, bar_ts, round(garch_var, 8) AS garch_var FROM g")
def _(s, d):
    return V.garch_variance(rets(s, d)).filter("garch_var is not null").select("symbol", "bar_ts", r("garch_var"))


@query("g03_chosen_variance", "rets", _ewma(f", {_GARCH} SELECT e.symbol, e.bar_ts, round(coalesce(greatest(1e-10, least(1e2, garch_var)), ewma_var, 1e-10), 8) AS var, round(sqrt(coalesce(greatest(1e-10, least(1e2, garch_var)), ewma_var, 1e-10)), 8) AS vol FROM e JOIN g ON e.symbol = g.symbol AND e.bar_ts = g.bar_ts"))
def _(s, d):
    v = V.garch_variance(V.ewma_variance(rets(s, d))).filter("garch_var is not null").withColumn("var", V.chosen_variance())
    return v.select("symbol", "bar_ts", r("var"), r(F.sqrt("var")).alias("vol"))


_LOSS = f"""l AS (SELECT symbol, bar_ts, power(ewma_var - ret * ret, 2) AS mse, ln(greatest(ewma_var, 1e-12)) + ret * ret / greatest(ewma_var, 1e-12) AS qlike FROM e WHERE ewma_var IS NOT NULL),
la AS (SELECT *, avg(mse) OVER w AS mse_avg, avg(qlike) OVER w AS qlike_avg FROM l WINDOW w AS ({_W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""


@query("g05_vol_losses", "rets", _ewma(f", {_LOSS} SELECT symbol, bar_ts, round(mse, 6) AS mse, round(qlike, 6) AS qlike, round(mse_avg, 6) AS mse_avg, round(qlike_avg, 6) AS qlike_avg FROM la"))
def _(s, d):
    return V.vol_losses(V.ewma_variance(rets(s, d)), "ewma_var").select("symbol", "bar_ts", r("mse", 6), r("qlike", 6), r("mse_avg", 6), r("qlike_avg", 6))


@query("g13_diagnostics_rollup", "rets", _ewma(f", {_LOSS} SELECT round(avg(m), 6) AS vol_mse_avg, round(avg(q), 6) AS vol_qlike_avg, count(*) AS symbols FROM (SELECT arg_max(mse_avg, bar_ts) AS m, arg_max(qlike_avg, bar_ts) AS q FROM la GROUP BY symbol)"))
def _(s, d):
    return V.diagnostics_rollup(V.vol_losses(V.ewma_variance(rets(s, d)), "ewma_var")).select(r("vol_mse_avg", 6), r("vol_qlike_avg", 6), "symbols")


def _cov_sql(w: int, first: str = "a * b") -> str:
    return f"""c{w} AS (SELECT bar_ts, sym_i, sym_j, CASE WHEN count(*) OVER w > 1 THEN covar_samp(a, b) OVER w WHEN sym_i = sym_j THEN {first} ELSE 0 END AS cov, count(*) OVER w AS n
FROM (SELECT x.bar_ts, x.symbol AS sym_i, y.symbol AS sym_j, x.ret AS a, y.ret AS b FROM rets x JOIN rets y ON x.bar_ts = y.bar_ts AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
WINDOW w AS (PARTITION BY sym_i, sym_j ORDER BY bar_ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"""


_COV = _cov_sql(250)


# A pair's first common bar has no sample covariance; the diagonal then has the chosen variance. As the symbol has but one
# return there, both estimates are missing and the choice is its floor.
@query("g06_rolling_covariance", "rets", f", {_cov_sql(250, '1e-10')} SELECT bar_ts, sym_i, sym_j, round(cov, 6) AS cov, CASE WHEN n = 1 THEN round(cov * 1e9, 3) END AS first_cov_e9, n FROM c250")
def _(s, d):
    v = V.garch_variance(V.ewma_variance(rets(s, d))).withColumn("var", V.chosen_variance())
    return V.rolling_covariance(v).select("bar_ts", "sym_i", "sym_j", r("cov", 6), F.when(F.col("n") == 1, F.round(F.col("cov") * 1e9, 3)).alias("first_cov_e9"), "n")


_TRIO = "('AF', 'NO', 'RF')"


@query("g08_cov_for_universe", "rets", f""", {_COV}, f AS (SELECT bar_ts, sym_i, sym_j, cov FROM c250 UNION ALL SELECT bar_ts, sym_j, sym_i, cov FROM c250 WHERE sym_i < sym_j)
SELECT bar_ts, sym_i, sym_j, round(cov, 6) AS cov FROM (SELECT *, count(*) OVER (PARTITION BY bar_ts) AS k FROM f WHERE sym_i IN {_TRIO} AND sym_j IN {_TRIO}) WHERE k = 9""")
def _(s, d):
    t = rets(s, d)
    trio = s.createDataFrame([("AF",), ("NO",), ("RF",)], "symbol string")
    universe = t.select("bar_ts").distinct().crossJoin(F.broadcast(trio))  # three symbols for each bar
    return V.cov_for_universe(V.rolling_covariance(t), universe).select("bar_ts", "sym_i", "sym_j", r("cov", 6))


@query("g11_cov_turnover", "rets", f", {_COV} SELECT bar_ts, round(sqrt(sum(x)), 6) AS cov_turnover FROM (SELECT bar_ts, power(cov - lag(cov) OVER (PARTITION BY sym_i, sym_j ORDER BY bar_ts), 2) * CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END AS x FROM c250) GROUP BY bar_ts")
def _(s, d):
    return V.cov_turnover(V.rolling_covariance(rets(s, d))).select("bar_ts", r("cov_turnover", 6))


@query("g09_mahalanobis_two", "rets", f""", {_COV}, p AS (SELECT bar_ts, max(cov) FILTER (sym_i = 'AF' AND sym_j = 'AF') AS a, max(cov) FILTER (sym_i = 'AF' AND sym_j = 'RF') AS b, max(cov) FILTER (sym_i = 'RF' AND sym_j = 'RF') AS c, max(n) FILTER (sym_i = 'AF' AND sym_j = 'RF') AS m FROM c250 WHERE sym_i IN ('AF', 'RF') AND sym_j IN ('AF', 'RF') GROUP BY bar_ts),
q AS (SELECT p.bar_ts, (c * x.ret * x.ret - 2 * b * x.ret * y.ret + a * y.ret * y.ret) / (a * c - b * b) AS d2 FROM p JOIN rets x ON x.bar_ts = p.bar_ts AND x.symbol = 'AF' JOIN rets y ON y.bar_ts = p.bar_ts AND y.symbol = 'RF' WHERE m >= 50)
SELECT bar_ts, round(d2, 6) AS d2, round(avg(d2 - 2) OVER (ORDER BY bar_ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) AS malv FROM q""")
def _(s, d):
    t = rets(s, d).filter(F.col("symbol").isin("AF", "RF"))
    c = V.rolling_covariance(t)
    late = c.filter("sym_i < sym_j and n >= 50").select("bar_ts")
    return V.malv(V.mahalanobis(c.join(late, "bar_ts", "left_semi"), t)).select("bar_ts", r("d2", 6), r("malv", 6))


@query("g09_mahalanobis")
def _(s, d):
    t = rets(s, d)
    return V.malv(V.mahalanobis(V.rolling_covariance(t), t)).select("bar_ts", "n", "d2", "malv")


_PORT = "p AS (SELECT * FROM (VALUES ('even', 'AF', 0.5), ('even', 'RF', 0.5), ('spread', 'AF', 0.7), ('spread', 'NO', -0.3)) AS t(portfolio, symbol, weight))"
_PVAR = """{n} AS (SELECT a.portfolio, c.bar_ts, sum(a.weight * b.weight * cov * CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END)::DOUBLE AS x FROM {c} c JOIN p a ON a.symbol = sym_i JOIN p b ON b.symbol = sym_j AND a.portfolio = b.portfolio GROUP BY 1, 2)"""


def _portfolios(s):
    return s.createDataFrame([("even", "AF", 0.5), ("even", "RF", 0.5), ("spread", "AF", 0.7), ("spread", "NO", -0.3)], "portfolio string, symbol string, weight double")


@query("g15_portfolio_variance", "rets", f", {_COV}, {_PORT}, {_PVAR.format(n='x', c='c250')} SELECT portfolio, bar_ts, round(x, 6) AS variance FROM x")
def _(s, d):
    return V.portfolio_variance(V.rolling_covariance(rets(s, d)), _portfolios(s)).select("portfolio", "bar_ts", r("variance", 6))


@query("g12_portfolio_cov_loss", "rets", f", {_COV}, {_cov_sql(60)}, {_PORT}, {_PVAR.format(n='x', c='c250')}, {_PVAR.format(n='y', c='c60')} SELECT bar_ts, round(avg(power(x.x - y.x, 2)), 6) AS cov_port_mse, round(avg(CASE WHEN x.x > 1e-12 AND y.x > 1e-12 THEN ln(x.x) + y.x / x.x END), 5) AS cov_port_qlike FROM x JOIN y USING (portfolio, bar_ts) GROUP BY bar_ts")
def _(s, d):
    t = rets(s, d)
    return V.portfolio_cov_loss(V.rolling_covariance(t), V.rolling_covariance(t, 60), _portfolios(s)).select("bar_ts", r("cov_port_mse", 6), r("cov_port_qlike", 5))


@query("g12_eigen_cov_loss")
def _(s, d):
    t = rets(s, d)
    return V.eigen_cov_loss(*(V.rolling_covariance(t, w).filter("n >= 30") for w in (250, 60)))


# H: portfolios. Momentum weights of two strategies.
_MOM = f"""m AS (SELECT symbol, bar_ts, close, ret, sum(log_ret) OVER a / nullif(sqrt(sum(log_ret * log_ret) OVER a), 0) AS m3, sum(log_ret) OVER b / nullif(sqrt(sum(log_ret * log_ret) OVER b), 0) AS m15
FROM rets WINDOW a AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS ({_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
weights AS (SELECT 'mom3' AS strategy_id, bar_ts, symbol, least(0.3, greatest(-0.3, m3 / 10)) AS weight FROM m WHERE m3 IS NOT NULL UNION ALL SELECT 'mom15', bar_ts, symbol, least(0.3, greatest(-0.3, m15 / 10)) FROM m WHERE m15 IS NOT NULL)"""


def weights(s, d):
    t = rets(s, d)
    one = lambda name, k: t.select(F.lit(name).alias("strategy_id"), "bar_ts", "symbol", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), E.tsmom("log_ret", k) / 10)).alias("weight"), "log_ret")
    both = one("mom3", 3).unionByName(one("mom15", 15))
    first = F.count("log_ret").over(Window.partitionBy("strategy_id", "symbol").orderBy("bar_ts")) > 0
    return both.withColumn("_ok", first).filter("_ok").drop("_ok", "log_ret")


@query("h00_momentum_weights", "rets", f", {_MOM} SELECT strategy_id, bar_ts, symbol, round(weight, 8) AS weight FROM weights")
def _(s, d):
    return weights(s, d).select("strategy_id", "bar_ts", "symbol", r("weight"))


def _caps_sql(source: str, out: str, lo, hi, gross, net) -> str:
    g = f"CASE WHEN g > {gross} THEN w * {gross} / g ELSE w END" if gross else "w"
    p = "OVER (PARTITION BY strategy_id, bar_ts)"
    return f"""{out} AS (SELECT strategy_id, bar_ts, symbol, least({hi}, greatest({lo}, w - CASE WHEN abs(net) > {net} THEN (net - sign(net) * {net}) / k ELSE 0 END)) AS weight
FROM (SELECT *, sum(w) {p} AS net, count(*) {p} AS k FROM (SELECT strategy_id, bar_ts, symbol, {g} AS w FROM (SELECT *, sum(abs(w)) {p} AS g FROM (SELECT strategy_id, bar_ts, symbol, least({hi}, greatest({lo}, weight)) AS w FROM {source})))))"""


_CAPS = _caps_sql("weights", "capped", -0.1, 0.1, 0.4, 0.05)


@query("h02_exposure_caps", "rets", f", {_MOM}, {_CAPS} SELECT strategy_id, bar_ts, symbol, round(weight, 8) AS weight FROM capped")
def _(s, d):
    return H.apply_exposure_caps(weights(s, d), -0.1, 0.1, 0.4, 0.05).select("strategy_id", "bar_ts", "symbol", r("weight"))


@query("h07_net_clamp", "rets", f", {_MOM}, {_caps_sql('weights', 'capped', -0.3, 0.3, None, 0.05)} SELECT strategy_id, bar_ts, symbol, round(weight, 8) AS weight FROM capped")
def _(s, d):
    return H.apply_exposure_caps(weights(s, d), -0.3, 0.3, 1.2, 0.05, gross=False).select("strategy_id", "bar_ts", "symbol", r("weight"))


_MU = "mu AS (SELECT w.strategy_id, w.bar_ts, w.symbol, 0.01 * m3 AS mu FROM weights w JOIN m USING (bar_ts, symbol))"


def _mu(s, d):
    t = rets(s, d).select("bar_ts", "symbol", (0.01 * E.tsmom("log_ret", 3)).alias("mu"))
    return weights(s, d).select("strategy_id", "bar_ts", "symbol").join(t, ["bar_ts", "symbol"])


@query("h01_mean_variance", "rets", f""", {_MOM}, {_MU}, c AS (SELECT bar_ts, symbol, greatest(var_samp(ret) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 1e-6) AS v, count(ret) OVER ({_W}) AS k FROM rets)
SELECT strategy_id, bar_ts, symbol, round(mu / (5 * v + 0.2), 8) AS weight FROM mu JOIN c USING (bar_ts, symbol) WHERE k >= 60 AND bar_ts >= TIMESTAMP '1998-01-01' AND mu IS NOT NULL""")
def _(s, d):
    w = G.by_symbol().rowsBetween(-59, 0)
    t = rets(s, d).select("bar_ts", "symbol", F.greatest(F.var_samp("ret").over(w), F.lit(1e-6)).alias("v"), F.count("ret").over(G.by_symbol()).alias("k")).filter((F.col("k") >= 60) & (F.col("bar_ts") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    mu = _mu(s, d).join(t.select("bar_ts", "symbol"), ["bar_ts", "symbol"], "left_semi").filter("mu is not null")
    own = t.select("bar_ts", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.col("v").alias("cov"))
    a, b = own.select("bar_ts", "sym_i"), own.select("bar_ts", "sym_j")
    rest = a.join(b, "bar_ts").filter("sym_i <> sym_j").withColumn("cov", F.lit(0.0))
    return H.mean_variance_weights(mu, own.unionByName(rest)).select("strategy_id", "bar_ts", "symbol", r("weight"))


@query("h01_mean_variance_full")
def _(s, d):
    return H.mean_variance_weights(_mu(s, d), V.full_matrix(V.rolling_covariance(rets(s, d))), H.lagged_weights(weights(s, d)))


_KELLY = f"""f AS (SELECT bar_ts, sym_i, sym_j, cov FROM c250 UNION ALL SELECT bar_ts, sym_j, sym_i, cov FROM c250 WHERE sym_i < sym_j),
mp AS (SELECT strategy_id, bar_ts, sum(coalesce(mu, 0) * weight) AS mu_p FROM weights JOIN mu USING (strategy_id, bar_ts, symbol) GROUP BY 1, 2),
vp AS (SELECT a.strategy_id, a.bar_ts, sum(a.weight * b.weight * cov) AS var_p FROM f JOIN weights a ON f.bar_ts = a.bar_ts AND sym_i = a.symbol JOIN weights b ON b.strategy_id = a.strategy_id AND b.bar_ts = a.bar_ts AND sym_j = b.symbol GROUP BY 1, 2),
kelly AS (SELECT strategy_id, bar_ts, mu_p, var_p, CASE WHEN var_p > 0 THEN least(2.0, greatest(0.0, mu_p / var_p)) ELSE 0 END AS f_star FROM mp JOIN vp USING (strategy_id, bar_ts))"""


@query("h03_kelly_fraction", "rets", f", {_MOM}, {_MU}, {_COV}, {_KELLY} SELECT strategy_id, bar_ts, round(mu_p, 8) AS mu_p, round(var_p, 6) AS var_p, round(f_star, 6) AS f_star FROM kelly WHERE abs(var_p) > 1e-6")
def _(s, d):
    cov = V.full_matrix(V.rolling_covariance(rets(s, d)))
    k = H.kelly_fraction(weights(s, d), _mu(s, d), cov).filter("abs(var_p) > 1e-6")
    return k.select("strategy_id", "bar_ts", r("mu_p"), r("var_p", 6), r("f_star", 6))


@query("h03_kelly_fraction_all")
def _(s, d):
    return H.kelly_fraction(weights(s, d), _mu(s, d), V.full_matrix(V.rolling_covariance(rets(s, d))))


_EQ = f""", {_MOM}, port AS (SELECT w.strategy_id, w.bar_ts, least(0.5, greatest(-0.5, sum(lw * m.ret) * 0.01)) AS r FROM (SELECT *, lag(weight) OVER (PARTITION BY strategy_id, symbol ORDER BY bar_ts) AS lw FROM weights) w JOIN m USING (bar_ts, symbol) WHERE lw IS NOT NULL AND m.ret IS NOT NULL GROUP BY 1, 2),
eq AS (SELECT strategy_id, bar_ts, 10000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy_id ORDER BY bar_ts)) AS nav FROM port),
ret2 AS (SELECT *, nav / lag(nav) OVER w - 1 AS ret, max(nav) OVER w AS peak FROM eq WINDOW w AS (PARTITION BY strategy_id ORDER BY bar_ts))"""


def equity(s, d):
    lw = F.lag("weight").over(Window.partitionBy("strategy_id", "symbol").orderBy("bar_ts"))
    w = weights(s, d).withColumn("lw", lw).filter("lw is not null").join(rets(s, d).filter("ret is not null").select("bar_ts", "symbol", "ret"), ["bar_ts", "symbol"])
    port = w.groupBy("strategy_id", "bar_ts").agg(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.sum(F.col("lw") * F.col("ret")) * 0.01)).alias("r"))
    return port.select("strategy_id", "bar_ts", (10000 * F.exp(F.sum(F.ln(1 + F.col("r"))).over(K.by_strategy()))).alias("nav"))


@query("h04_kelly_lambda", "rets", _EQ + """, x AS (SELECT *, (peak - nav) / peak AS dd, CASE WHEN count(*) OVER w < 5 THEN 0 ELSE stddev_samp(ret) OVER (PARTITION BY strategy_id ORDER BY bar_ts ROWS BETWEEN 198 PRECEDING AND CURRENT ROW) END AS vol FROM ret2 WINDOW w AS (PARTITION BY strategy_id ORDER BY bar_ts)),
y AS (SELECT *, CASE WHEN dd >= 0.2 THEN 0.1 WHEN dd >= 0.1 THEN 0.25 WHEN dd >= 0.05 THEN 0.4 ELSE 0.5 END AS l FROM x) SELECT strategy_id, bar_ts, round(dd, 8) AS drawdown, round(CASE WHEN vol > 0 THEN l / (1 + greatest(0, vol - 0.05)) ELSE l END, 8) AS lambda FROM y""")
def _(s, d):
    e = V.nav_volatility(K.drawdowns(equity(s, d)))
    return e.select("strategy_id", "bar_ts", r("drawdown"), r(H.kelly_lambda(F.col("drawdown"), F.col("nav_vol"))).alias("lambda"))


@query("h05_constraint_scale", "rets", f", {_MOM} SELECT strategy_id, bar_ts, round(coalesce(least(min(CASE WHEN weight > 0 THEN 0.3 / weight WHEN weight < 0 THEN -0.3 / weight END), 1.2 / nullif(sum(abs(weight)), 0), 0.25 / nullif(abs(sum(weight)), 0)), 0), 4) AS scale FROM weights GROUP BY ALL HAVING abs(sum(weight)) > 1e-6")
def _(s, d):
    w = weights(s, d)
    big = w.groupBy("strategy_id", "bar_ts").agg(F.abs(F.sum("weight")).alias("n")).filter("n > 1e-6").drop("n")
    return H.max_constraint_scale(w).join(big, ["strategy_id", "bar_ts"], "left_semi").select("strategy_id", "bar_ts", r("scale", 4))


@query("h05_constraint_scale_all")
def _(s, d):
    return H.max_constraint_scale(weights(s, d))


@query("h06_scaled_weights", "rets", f", {_MOM}, s AS (SELECT strategy_id, bar_ts, least(0.5, 0.4 / sum(abs(weight))) AS k FROM weights GROUP BY ALL) SELECT strategy_id, bar_ts, symbol, round(weight * k, 8) AS weight FROM weights JOIN s USING (strategy_id, bar_ts)")
def _(s, d):
    w = weights(s, d)
    gross = w.groupBy("strategy_id", "bar_ts").agg((0.4 / F.sum(F.abs("weight"))).alias("scale"))
    half = w.groupBy("strategy_id", "bar_ts").agg(F.lit(0.5).alias("scale"))
    return H.scale_weights(w, gross, half).select("strategy_id", "bar_ts", "symbol", r("weight"))


_CHG = """, nx AS (SELECT strategy_id, bar_ts, lead(bar_ts) OVER (PARTITION BY strategy_id ORDER BY bar_ts) AS t FROM (SELECT DISTINCT strategy_id, bar_ts FROM weights)),
lw AS (SELECT strategy_id, t AS bar_ts, symbol, weight FROM weights JOIN nx USING (strategy_id, bar_ts) WHERE t IS NOT NULL),
ch AS (SELECT strategy_id, bar_ts, symbol, coalesce(l.weight, 0) AS w_prev, coalesce(w.weight, 0) AS w_new FROM lw l FULL JOIN weights w USING (strategy_id, bar_ts, symbol))"""
_COST = "co AS (SELECT strategy_id, bar_ts, sum(abs(w_new - w_prev) * 10000 * 0.0004) AS fee_cost, sum(abs(w_new - w_prev) * 10000 * 5 / 1e4) AS slippage_cost FROM ch GROUP BY ALL)"


def changes(s, d):
    w = weights(s, d)
    return H.weight_changes(H.lagged_weights(w), w)


@query("h08_cost_budget", "rets", f", {_MOM} {_CHG}, {_COST} SELECT strategy_id, bar_ts, symbol, round(w_prev + (w_new - w_prev) * CASE WHEN (fee_cost + slippage_cost) > 1 THEN 1 / (fee_cost + slippage_cost) ELSE 1 END, 8) AS weight FROM ch JOIN co USING (strategy_id, bar_ts)")
def _(s, d):
    c = changes(s, d)
    return H.apply_cost_budget(c, H.expected_costs(c, 10_000.0), 1.0).select("strategy_id", "bar_ts", "symbol", r("weight"))


@query("h09_expected_costs", "rets", f", {_MOM} {_CHG}, {_COST} SELECT strategy_id, bar_ts, round(fee_cost, 6) AS fee_cost, round(slippage_cost, 6) AS slippage_cost, round(fee_cost + slippage_cost, 6) AS total_cost, round((fee_cost + slippage_cost) / 10000 * 1e4, 6) AS total_cost_bp FROM co")
def _(s, d):
    return H.expected_costs(changes(s, d), 10_000.0).select("strategy_id", "bar_ts", *[r(c, 6) for c in ("fee_cost", "slippage_cost", "total_cost", "total_cost_bp")])


_TURN = "tu AS (SELECT strategy_id, bar_ts, sum(abs(w_new - w_prev)) AS turnover FROM ch GROUP BY ALL)"


@query("h10_turnover", "rets", f", {_MOM} {_CHG}, {_TURN} SELECT strategy_id, bar_ts, round(turnover, 8) AS turnover FROM tu")
def _(s, d):
    return H.turnover(weights(s, d)).select("strategy_id", "bar_ts", r("turnover"))


@query("h11_covariance_turnover")
def _(s, d):
    return H.covariance_turnover(_mu(s, d), V.full_matrix(V.rolling_covariance(rets(s, d))), H.lagged_weights(weights(s, d)))


@query("h12_generate_orders", "rets", f"""  , {_MOM} {_CHG}, o AS (SELECT ch.*, close AS price, abs(w_new - w_prev) * 10000 AS n, CASE WHEN close > 0 THEN floor((abs(w_new - w_prev) * 10000 / close + 1e-12) / 0.001) * 0.001 END AS q FROM ch LEFT JOIN m USING (bar_ts, symbol))
SELECT strategy_id, bar_ts, symbol, CASE WHEN w_new - w_prev > 0 THEN 'buy' ELSE 'sell' END AS side, round(q, 6) AS quantity, round(q * price, 6) AS notional, round(w_new, 8) AS target_weight,
CASE WHEN abs(w_new - w_prev) < 1e-4 THEN 'small_change' WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN n < 10 THEN 'min_notional' WHEN q < 0.01 OR q <= 0 THEN 'min_qty' WHEN q * price < 10 THEN 'min_notional' END AS skip_reason FROM o""")
def _(s, d):
    t = rets(s, d)
    filters = t.select("symbol").distinct().select("symbol", F.lit(0.001).alias("step_size"), F.lit(0.01).alias("min_qty"), F.lit(10.0).alias("min_notional"), F.lit(1.0).alias("multiplier"))
    o = H.generate_orders(changes(s, d), t, filters, 10_000.0)
    return o.select("strategy_id", "bar_ts", "symbol", "side", r("quantity", 6), r("notional", 6), r("target_weight"), "skip_reason")


_PRED = f"preds AS (SELECT symbol, bar_ts AS ts, 0.1 * lag(log_ret) OVER ({_W}) + 0.001 * (day(bar_ts) % 3 - 1) AS y_pred_logret, log_ret AS y_true_logret, date_diff('day', DATE '1995-01-01', bar_ts::DATE) // 30 AS step FROM rets), pr AS (SELECT * FROM preds WHERE y_pred_logret IS NOT NULL AND y_true_logret IS NOT NULL)"


def predictions(s, d):
    t = rets(s, d)
    pred = 0.1 * F.lag("log_ret").over(G.by_symbol()) + 0.001 * (F.dayofmonth("bar_ts") % 3 - 1)
    step = F.floor(F.datediff(F.to_date("bar_ts"), F.lit("1995-01-01").cast("date")) / 30)
    return t.select("symbol", F.col("bar_ts").alias("ts"), pred.alias("y_pred_logret"), F.col("log_ret").alias("y_true_logret"), step.alias("step")).dropna(subset=["y_pred_logret", "y_true_logret"])


@query("c06_sigma_gate_checked", "rets", f", {_PRED}, sg AS (SELECT symbol, bar_ts AS ts, stddev_samp(log_ret) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sigma FROM rets) SELECT symbol, ts, round(y_pred_logret, 8) AS y_pred_logret, round(sigma, 6) AS sigma FROM pr JOIN sg USING (symbol, ts) WHERE sigma IS NULL OR sigma <= 1.5")
def _(s, d):
    sigma = rets(s, d).select("symbol", F.col("bar_ts").alias("ts"), F.stddev_samp("log_ret").over(G.by_symbol().rowsBetween(-29, 0)).alias("sigma"))
    return I.sigma_gate(predictions(s, d).join(sigma, ["symbol", "ts"]), 1.5).select("symbol", "ts", r("y_pred_logret"), r("sigma", 6))


@query("c06_sigma_gate")
def _(s, d):
    sigma = rets(s, d).select("symbol", F.col("bar_ts").alias("ts"), F.stddev_samp("log_ret").over(G.by_symbol().rowsBetween(-29, 0)).alias("sigma"))
    return I.sigma_gate(predictions(s, d).join(sigma, ["symbol", "ts"]), 2.0)


@query("h13_validate_predictions", "rets", f", {_PRED} SELECT s.symbol, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(min(ts) <= TIMESTAMP '1996-01-01' AND max(ts) >= TIMESTAMP '1998-01-01', false) AS covered FROM (SELECT DISTINCT symbol FROM rets UNION SELECT 'ZZ') s LEFT JOIN pr ON s.symbol = pr.symbol GROUP BY s.symbol")
def _(s, d):
    symbols = rets(s, d).select("symbol").distinct().union(s.createDataFrame([("ZZ",)], "symbol string"))
    return H.validate_predictions(predictions(s, d), symbols, "1996-01-01", "1998-01-01")


@query("h14_drawdown", "rets", _EQ + " SELECT strategy_id, bar_ts, round(nav, 4) AS nav, round((greatest(peak, 10500) - nav) / greatest(peak, 10500), 8) AS drawdown FROM ret2")
def _(s, d):
    return K.drawdowns(equity(s, d), 10_500.0).select("strategy_id", "bar_ts", r("nav", 4), r("drawdown"))


@query("h15_realized_slippage", "fills", "SELECT ts AS bar_ts, round(sum((avg_px / price - 1) * CASE WHEN side = 'buy' THEN 1 ELSE -1 END * abs(qty * price)) / sum(abs(qty * price)) * 1e4, 6) AS slippage_bp FROM (SELECT ts, symbol, side, sum(qty) AS qty, sum(qty * price * (1 + seq % 7 / 1e4)) / sum(qty) AS avg_px, max(200.0) AS price FROM fills GROUP BY ts, symbol, side) GROUP BY ts")
def _(s, d):
    f = X.fills(s, d)
    ex = f.groupBy(F.col("ts").alias("bar_ts"), "symbol", "side").agg(F.sum("qty").alias("quantity"), F.collect_list(F.struct((F.col("price") * (1 + F.col("seq") % 7 / 1e4)).alias("price"), "qty")).alias("fills"))
    mids = f.select(F.col("ts").alias("bar_ts"), "symbol", F.lit(200.0).alias("mid")).distinct()
    return H.realized_slippage(ex, mids).select("bar_ts", r("slippage_bp", 6))


@query("h16_execution_status", "fills", "SELECT ts AS bar_ts, CASE WHEN bool_and(seq % 5 <> 0) THEN 'completed' ELSE 'partial' END AS status, coalesce(list(symbol ORDER BY symbol) FILTER (seq % 5 = 0), []) AS failed FROM fills GROUP BY ts")
def _(s, d):
    return H.execution_status(X.fills(s, d).select(F.col("ts").alias("bar_ts"), "symbol", (F.col("seq") % 5 != 0).alias("success")))


@query("h17_rebalance_path")
def _(s, d):
    t = rets(s, d).filter("ret is not null")
    one = lambda x: F.lit(x).cast("double")
    m = t.select("bar_ts", F.struct("symbol", (0.01 * E.tsmom("log_ret", 3)).alias("mu"), (F.col("ret") * 0.01).alias("rets"), F.col("close").alias("prices"), one(0.001).alias("step_size"), one(0.01).alias("min_qty"), one(10).alias("min_notional"), one(1).alias("multiplier")).alias("m"))
    cov = V.full_matrix(V.rolling_covariance(t).filter("n >= 60"))
    whole = cov.groupBy("bar_ts").agg(F.transform(F.sort_array(F.collect_list(F.struct("sym_i", "sym_j", "cov"))), lambda x: x["cov"]).alias("cov"))
    per = m.groupBy("bar_ts").agg(F.sort_array(F.collect_list("m")).alias("m")).select("bar_ts", F.col("m.symbol").alias("symbols"), *[f"m.{c}" for c in ("mu", "rets", "prices", "step_size", "min_qty", "min_notional", "multiplier")])
    inputs = per.join(whole, "bar_ts", "left")
    grid = s.createDataFrame([(f"g{g}_l{lam}", float(g), lam, 10.0) for g in (1, 5) for lam in (0.0, 0.1)], "strategy_id string, gamma double, lam double, budget_bp double")
    return H.rebalance_path(inputs, grid)


# I: forecasts
_FOLDS = "folds AS (SELECT row_number() OVER (ORDER BY anchor) - 1 AS fold, anchor, least(anchor + INTERVAL 60 DAY, TIMESTAMP '1998-01-01') AS fold_end FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01' - INTERVAL 1 SECOND, INTERVAL 60 DAY)) AS anchor))"


def folds(s):
    return I.walk_forward_folds(s, "1996-01-01", "1998-01-01", 60)


@query("i01_walk_forward_folds", "rets", f", {_FOLDS} SELECT symbol, fold, part, count(*) AS n, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts FROM (SELECT r.symbol, r.bar_ts, fold, 'train' AS part FROM rets r JOIN folds ON bar_ts < anchor UNION ALL SELECT r.symbol, r.bar_ts, fold, 'test' FROM rets r JOIN folds ON bar_ts >= anchor AND bar_ts < fold_end) GROUP BY ALL")
def _(s, d):
    a = I.assign_folds(rets(s, d), folds(s), "bar_ts")
    return a.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


@query("i02_validation_split", "rets", f", {_FOLDS} SELECT symbol, fold, greatest(1, floor(count(*) * 0.2))::BIGINT AS n_val, (count(*) - greatest(1, floor(count(*) * 0.2)))::BIGINT AS n_fit FROM rets JOIN folds ON bar_ts < anchor GROUP BY ALL")
def _(s, d):
    t = I.assign_folds(rets(s, d), folds(s), "bar_ts").filter("part = 'train'")
    return I.validation_split(t, ts="bar_ts").groupBy("symbol", "fold").agg(F.count_if("is_val").alias("n_val"), F.count_if(~F.col("is_val")).alias("n_fit"))


def sequences(s, d):
    t = rets(s, d).select("symbol", "bar_ts", F.col("log_ret").alias("log_return"), F.log1p("volume").alias("log_volume"))
    return E.supervised_sequences(t, 8, ["log_return", "log_volume"])


@query("i03_fit_standardizer", "rets", f""", {_FOLDS}, v AS (SELECT symbol, bar_ts, log_ret, ln(1 + volume) AS lv, row_number() OVER ({_W}) AS n FROM rets WHERE log_ret IS NOT NULL),
q AS (SELECT a.symbol, a.bar_ts, fold, a.n, a.log_ret AS y FROM v a JOIN folds ON a.bar_ts < anchor WHERE a.n > 8),
x AS (SELECT q.symbol, fold, b.log_ret, b.lv FROM q JOIN v b ON b.symbol = q.symbol AND b.n BETWEEN q.n - 8 AND q.n - 1),
u AS (SELECT symbol, fold, 0 AS feature, log_ret AS v FROM x UNION ALL SELECT symbol, fold, 1, lv FROM x UNION ALL SELECT symbol, fold, -1, y FROM q)
SELECT symbol, fold, feature, round(avg(v), 8) AS mean, round(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END, 8) AS std FROM u GROUP BY ALL""")
def _(s, d):
    t = I.assign_folds(sequences(s, d), folds(s)).filter("part = 'train'")
    return I.fit_standardizer(t).select("symbol", "fold", "feature", r("mean"), r("std"))


@query("i05_score_windows")
def _(s, d):
    a = I.assign_folds(sequences(s, d), folds(s))
    fit = I.fit_standardizer(a.filter("part = 'train'"))
    models = {x: I.LastValue() for x in ("AF", "AO", "NF", "NO", "RF", "RO")}
    return I.score_windows(I.standardize(a.filter("part = 'test'"), fit), models)


def _metrics_sql(keys: str) -> str:
    p = f"PARTITION BY {keys}"
    return f""", {_PRED}, k AS (SELECT *, rank() OVER ({p} ORDER BY y_pred_logret) + (count(*) OVER ({p}, y_pred_logret) - 1) / 2.0 AS rp, rank() OVER ({p} ORDER BY y_true_logret) + (count(*) OVER ({p}, y_true_logret) - 1) / 2.0 AS rt, y_pred_logret - y_true_logret AS e FROM pr)
SELECT {keys}, count(*) AS n, round(avg(e * e), 8) AS mse, round(sqrt(avg(e * e)), 8) AS rmse, round(avg(abs(e)), 8) AS mae, round(CASE WHEN count(*) > 1 AND stddev_pop(y_pred_logret) > 0 AND stddev_pop(y_true_logret) > 0 THEN corr(y_pred_logret, y_true_logret) END, 8) AS ic_pearson,
round(CASE WHEN count(*) > 1 AND stddev_pop(rp) > 0 AND stddev_pop(rt) > 0 THEN corr(rp, rt) END, 8) AS ic_spearman, round(avg(CASE WHEN sign(y_pred_logret) = sign(y_true_logret) THEN 1.0 ELSE 0.0 END), 8) AS sign_accuracy FROM k GROUP BY {keys}"""


def _metrics(s, d, *keys):
    m = I.forecast_metrics(predictions(s, d), *keys)
    return m.select(*keys, "n", *[r(c) for c in ("mse", "rmse", "mae", "ic_pearson", "ic_spearman", "sign_accuracy")])


@query("i07_forecast_metrics", "rets", _metrics_sql("symbol"))
def _(s, d):
    return _metrics(s, d, "symbol")


@query("i08_fold_metrics", "rets", _metrics_sql("symbol, step"))
def _(s, d):
    return _metrics(s, d, "symbol", "step")


@query("i08_fold_and_overall", "rets", f", {_PRED} SELECT symbol, step, count(*) AS n, round(avg(power(y_pred_logret - y_true_logret, 2)), 8) AS mse, round(avg(abs(y_pred_logret - y_true_logret)), 8) AS mae FROM pr GROUP BY GROUPING SETS ((symbol, step), (symbol))")
def _(s, d):
    return I.fold_and_overall_errors(predictions(s, d)).select("symbol", "step", "n", r("mse"), r("mae"))


@query("i09_forecast_frame", "rets", f", {_PRED} SELECT ts, count(*) AS n, count(*) / 6.0::DOUBLE AS coverage, round(avg(exp(y_pred_logret) - 1), 8) AS mean_mu, round(max(exp(y_pred_logret) - 1), 8) AS max_mu, median(exp(y_pred_logret) - 1) IS NOT NULL AS known FROM pr GROUP BY ts")
def _(s, d):
    return I.forecast_frame(predictions(s, d), 6).select("ts", "n", "coverage", r("mean_mu"), r("max_mu"), (F.size("expected") == F.col("n")).alias("known"))


@query("i11_read_at_bars", "rets", f", {_PRED} SELECT b.symbol, b.bar_ts, round(exp(y_pred_logret) - 1, 8) AS mu FROM (SELECT *, lead(bar_ts) OVER ({_W}) AS t FROM bars) b JOIN pr ON pr.symbol = b.symbol AND pr.ts = b.t")
def _(s, d):
    return I.read_at_bars(X.daily_bars(s, d), predictions(s, d), 1).select("symbol", "bar_ts", r("mu"))


# J: ledger
_POS = """pf AS (SELECT *, price * (1 + 5 / 1e4 * CASE WHEN side = 'buy' THEN 1 ELSE -1 END) AS fill_px, qty * CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sq FROM fills),
pos AS (SELECT *, sum(sq) OVER (PARTITION BY account, symbol ORDER BY ts, seq) AS position FROM pf)"""


def priced(s, d):
    return J.price_fills(X.fills(s, d))


@query("j01_price_fills", "fills", f", {_POS} SELECT seq, round(fill_px, 6) AS fill_px, round(qty * fill_px, 6) AS notional, round(qty * fill_px * 0.0004, 6) AS fee FROM pf")
def _(s, d):
    return priced(s, d).select("seq", r("fill_px", 6), r("notional", 6), r("fee", 6))


@query("j02_net_positions", "fills", f", {_POS} SELECT seq, position, CASE WHEN position - sq = 0 THEN 'open' WHEN position = 0 THEN 'close' WHEN sign(position) <> sign(position - sq) THEN 'flip' WHEN abs(position) > abs(position - sq) THEN 'add' ELSE 'reduce' END AS action FROM pos")
def _(s, d):
    return J.net_positions(priced(s, d)).select("seq", "position", "action")


#: The fold over fills of one position, as a recursion in SQL.
_LEDGER = f"""{_POS}, k AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY ts, seq) AS n FROM pos),
led AS (SELECT account, symbol, ts, seq, n, position, fill_px AS entry, 0.0::DOUBLE AS realized, abs(position) * fill_px AS margin, -qty * fill_px * 0.0004 - abs(position) * fill_px AS cash FROM k WHERE n = 1
UNION ALL SELECT account, symbol, ts, seq, n, position, entry, realized, margin, cash0 + realized - qty * fill_px * 0.0004 + margin0 - margin FROM (
SELECT k.account, k.symbol, k.ts, k.seq, k.n, k.position, k.qty, k.fill_px, l.cash AS cash0, l.margin AS margin0, abs(k.position) * k.fill_px AS margin,
CASE WHEN l.position = 0 OR sign(l.position) <> sign(k.position) THEN k.fill_px WHEN abs(k.position) > abs(l.position) THEN (l.entry * abs(l.position) + k.fill_px * k.qty) / abs(k.position) ELSE l.entry END AS entry,
CASE WHEN l.position = 0 THEN 0 WHEN k.position = 0 OR sign(l.position) <> sign(k.position) THEN (k.fill_px - l.entry) * l.position WHEN abs(k.position) < abs(l.position) THEN (k.fill_px - l.entry) * -k.sq ELSE 0 END AS realized
FROM led l JOIN k ON k.account = l.account AND k.symbol = l.symbol AND k.n = l.n + 1))"""


@query("j03_position_ledger", "fills", f", {_LEDGER} SELECT seq, position, round(CASE WHEN position <> 0 THEN entry END, 6) AS entry, round(realized, 4) AS realized, round(margin, 4) AS margin, round(cash, 4) AS cash FROM led")
def _(s, d):
    return J.position_ledger(priced(s, d)).select("seq", "position", r("entry", 6), r("realized", 4), r("margin", 4), r("cash", 4))


def _payments(s, d):
    f = X.fills(s, d)
    months = f.select("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    times = months.select("ts").distinct().crossJoin(F.broadcast(f.select("symbol").distinct()))  # five symbols for each month
    px = f.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bar_ts")).agg(F.max_by("price", F.struct("ts", "seq")).alias("close"))
    n = J.net_positions(J.price_fills(f))
    last = n.groupBy("account", "symbol", "ts").agg(F.max_by("position", "seq").alias("position"))
    return J.funding_payments(last, times.withColumn("rate", F.lit(0.001)), px)


@query("j07_funding_payments", "fills", f""", {_POS}, t AS (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS ts FROM fills), a AS (SELECT DISTINCT account, symbol FROM fills), lastpos AS (SELECT account, symbol, ts, arg_max(position, seq) AS position FROM pos GROUP BY ALL),
px AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS bar_ts, arg_max(price, row(ts, seq)) AS close FROM fills GROUP BY 1, 2)
SELECT account, symbol, ts, round(-position * close * 0.001, 9) AS payment FROM (SELECT a.account, a.symbol, t.ts, p.position, x.close FROM t CROSS JOIN a ASOF LEFT JOIN lastpos p ON p.account = a.account AND p.symbol = a.symbol AND p.ts <= t.ts ASOF LEFT JOIN px x ON x.symbol = a.symbol AND x.bar_ts <= t.ts) WHERE position <> 0 AND close IS NOT NULL""")
def _(s, d):
    return _payments(s, d).select("account", "symbol", "ts", r("payment", 9))


def _curve(s, d):
    f = X.fills(s, d)
    led = J.position_ledger(J.price_fills(f))
    months = f.select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    marks = months.crossJoin(F.broadcast(f.select("symbol").distinct())).withColumn("mark", F.lit(200.0))  # five symbols for each month
    return led, marks, J.equity_curve(led, marks)


_CURVE = """st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, symbol, ts ORDER BY seq DESC) AS z FROM led) WHERE z = 1),
t AS (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS ts FROM fills), a AS (SELECT DISTINCT account, symbol FROM fills),
x AS (SELECT a.account, a.symbol, t.ts, coalesce(s.position, 0) AS position, coalesce(s.cash, 0) AS cash, coalesce(s.margin, 0) AS margin, coalesce((200 - CASE WHEN s.position <> 0 THEN s.entry ELSE 0 END) * s.position, 0) AS profit
FROM t CROSS JOIN a ASOF LEFT JOIN st s ON s.account = a.account AND s.symbol = a.symbol AND s.ts <= t.ts),
curve AS (SELECT account, ts, 10000 + sum(cash) AS cash, sum(profit) AS unrealized, sum(margin) AS margin, 10000 + sum(cash) + sum(margin) + sum(profit) AS equity FROM x GROUP BY ALL)"""


@query("j08_equity_curve", "fills", f", {_LEDGER}, {_CURVE} SELECT account, ts, round(cash, 3) AS cash, round(unrealized, 3) AS unrealized, round(margin, 3) AS margin, round(equity, 3) AS equity FROM curve")
def _(s, d):
    return _curve(s, d)[2].select("account", "ts", r("cash", 3), r("unrealized", 3), r("margin", 3), r("equity", 3))


@query("j09_exposure_report", "fills", f", {_LEDGER}, {_CURVE} SELECT account, ts, round(g / equity, 5) AS gross, round(n / equity, 5) AS net, coalesce(g / equity > 1.2 OR abs(n / equity) > 0.25, false) AS breach FROM (SELECT account, ts, sum(abs(position * 200.0::DOUBLE)) AS g, sum(position * 200.0::DOUBLE) AS n FROM x GROUP BY ALL) JOIN curve USING (account, ts) WHERE equity > 0")
def _(s, d):
    led, marks, curve = _curve(s, d)
    last = led.groupBy("account", "symbol", "ts").agg(F.max_by("position", "seq").alias("position"))
    at = J.as_of(marks.join(led.select("account", "symbol").distinct(), "symbol"), last, ["account", "symbol"], "ts", ["position"]).withColumn("position", F.coalesce("position", F.lit(0.0)))
    return J.exposure_report(at, curve.filter("equity > 0")).select("account", "ts", r("gross", 5), r("net", 5), "breach")


@query("j10_closing_fills", "fills", f", {_POS} SELECT account, symbol, CASE WHEN p > 0 THEN 'sell' ELSE 'buy' END AS side, abs(p) AS qty, round(px, 6) AS price FROM (SELECT account, symbol, arg_max(position, row(ts, seq)) AS p, arg_max(fill_px, row(ts, seq)) AS px FROM pos GROUP BY ALL) WHERE p <> 0")
def _(s, d):
    return J.closing_fills(J.net_positions(priced(s, d)), "2000-01-01").select("account", "symbol", "side", "qty", r("price", 6))


@query("j12_open_positions", "fills", f", {_POS} SELECT account, symbol, position, round(px, 6) AS fill_px FROM (SELECT account, symbol, arg_max(position, row(ts, seq)) AS position, arg_max(fill_px, row(ts, seq)) AS px FROM pos GROUP BY ALL) WHERE position <> 0")
def _(s, d):
    return J.open_positions(J.net_positions(priced(s, d))).select("account", "symbol", "position", r("fill_px", 6))


@query("j11_trade_log", "fills", f", {_POS} SELECT type, count(*) AS n, round(sum(qty), 4) AS qty FROM (SELECT CASE WHEN position - sq <> 0 AND (position = 0 OR (sign(position) = sign(position - sq) AND abs(position) <= abs(position - sq))) THEN 'close' ELSE 'open' END AS type, qty FROM pos) GROUP BY type")
def _(s, d):
    n = J.net_positions(priced(s, d))
    none = n.select("account", "symbol", "ts", F.lit(0.0).alias("payment")).filter("false")
    return J.trade_log(n, none).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("qty"), 4).alias("qty"))


@query("j11_trade_log_funding")
def _(s, d):
    return J.trade_log(J.net_positions(priced(s, d)), _payments(s, d))


# K: performance
@query("k01_bar_returns", "rets", _EQ + " SELECT strategy_id, bar_ts, round(ret, 8) AS ret FROM ret2")
def _(s, d):
    return K.bar_returns(equity(s, d)).select("strategy_id", "bar_ts", r("ret"))


_SUM = """su AS (SELECT strategy_id, count(*) AS bars, arg_max(nav, bar_ts) - 10000 AS pnl, (arg_max(nav, bar_ts) / 10000 - 1) * 100 AS cum_return_pct, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe, coalesce(stddev_samp(ret) * sqrt(365), 0) AS volatility,
max((peak - nav) / peak) AS max_drawdown, avg((peak - nav) / peak) AS avg_drawdown, coalesce(avg(ret) FILTER (ret > 0), 0) AS avg_win, coalesce(-avg(ret) FILTER (ret < 0), 0) AS avg_loss, coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ret IS NOT NULL), 0) AS winrate_per_bar FROM ret2 GROUP BY strategy_id)"""
_METRICS = ["pnl", "cum_return_pct", "sharpe", "volatility", "max_drawdown", "avg_drawdown", "avg_win", "avg_loss", "winrate_per_bar"]


@query("k02_performance_summary", "rets", _EQ + f", {_SUM} SELECT strategy_id, bars, {', '.join(f'round({c}, 5) AS {c}' for c in _METRICS)} FROM su")
def _(s, d):
    return K.performance_summary(equity(s, d), "1d", 10_000.0).select("strategy_id", "bars", *[r(c, 5) for c in _METRICS])


@query("k07_winrate_per_order", "rets", _EQ + """, o AS (SELECT strategy_id, count(*) AS orders FROM weights GROUP BY 1), w AS (SELECT strategy_id, count(*) AS wins FROM ret2 WHERE ret > 0 AND bar_ts IN (SELECT bar_ts FROM rets WHERE day(bar_ts) % 2 = 0) GROUP BY 1)
SELECT strategy_id, coalesce(wins, 0) AS wins, orders, round(coalesce(wins, 0) / orders, 8) AS winrate_per_order FROM o LEFT JOIN w USING (strategy_id)""")
def _(s, d):
    f = rets(s, d).filter("dayofmonth(bar_ts) % 2 = 0")
    return K.win_rate_per_order(K.bar_returns(equity(s, d)), f, weights(s, d)).select("strategy_id", "wins", "orders", r("winrate_per_order"))


@query("k08_turnover_stats", "rets", f", {_MOM} {_CHG}, {_TURN}, c AS (SELECT DISTINCT bar_ts FROM bars), i AS (SELECT DISTINCT strategy_id FROM tu) SELECT strategy_id, round(avg(coalesce(turnover, 0)), 8) AS turnover_mean, round(sum(coalesce(turnover, 0)), 6) AS turnover_sum FROM c CROSS JOIN i LEFT JOIN tu USING (strategy_id, bar_ts) GROUP BY strategy_id")
def _(s, d):
    return K.turnover_stats(H.turnover(weights(s, d)), G.clock(X.daily_bars(s, d))).select("strategy_id", r("turnover_mean"), r("turnover_sum", 6))


_BENCH = "be AS (SELECT bar_ts, 10000 / first_value(close) OVER (ORDER BY bar_ts) * close AS nav FROM bars WHERE symbol = 'AF')"


@query("k09_benchmark_curve", "bars", f", {_BENCH} SELECT 'hold_AF' AS strategy_id, bar_ts, round(nav, 4) AS nav FROM be")
def _(s, d):
    return K.benchmark_curve(X.daily_bars(s, d), "AF", 10_000.0).select("strategy_id", "bar_ts", r("nav", 4))


@query("k10_ras_bounds", "rets", _EQ + " SELECT strategy_id, round(avg(ret), 8) AS mean, count(ret) AS n, round(avg(ret) - sqrt(2 * ln(2 / 0.05) / count(ret)), 8) AS lower FROM ret2 GROUP BY strategy_id")
def _(s, d):
    return K.ras_bounds(K.bar_returns(equity(s, d))).select("strategy_id", r("mean"), "n", r("lower"))


@query("k11_ras_ic", "rets", f", {_PRED}, ic AS (SELECT symbol, step, corr(y_pred_logret, y_true_logret) AS ic FROM pr GROUP BY ALL HAVING count(*) > 5) SELECT symbol, round(avg(ic), 7) AS mean, count(ic) AS n, round(avg(ic) - sqrt(2 * ln(2 / 0.05) / count(ic)), 7) AS lower FROM ic GROUP BY symbol")
def _(s, d):
    ic = predictions(s, d).groupBy("symbol", "step").agg(F.corr("y_pred_logret", "y_true_logret").alias("ic"), F.count("*").alias("k")).filter("k > 5")
    return K.ras_bounds(ic, value="ic", key="symbol").select("symbol", r("mean", 7), "n", r("lower", 7))


@query("k12_avg_diagnostics", "rets", "SELECT metric, round(avg(value), 8) AS value FROM (SELECT 'ret' AS metric, ret AS value FROM rets WHERE ret IS NOT NULL UNION ALL SELECT 'volume', volume FROM rets WHERE day(bar_ts) % 2 = 0) GROUP BY metric")
def _(s, d):
    m = F.map_filter(F.create_map(F.lit("ret"), F.col("ret"), F.lit("volume"), F.when(F.dayofmonth("bar_ts") % 2 == 0, F.col("volume"))), lambda k, v: v.isNotNull())
    return K.avg_diagnostics(rets(s, d).select(m.alias("m")), "m").select("metric", r("value"))


@query("k13_summary_long", "rets", _EQ + f", {_SUM}, u AS (UNPIVOT (SELECT strategy_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _METRICS)} FROM su) ON {', '.join(_METRICS)} INTO NAME metric VALUE value) SELECT strategy_id, metric, round(value, 5) AS value FROM u")
def _(s, d):
    return K.long_metrics(K.performance_summary(equity(s, d), "1d", 10_000.0)).select("strategy_id", "metric", r("value", 5))


@query("k14_against_benchmark", "rets", _EQ + f", {_BENCH} SELECT strategy_id, e.bar_ts, round(e.nav, 4) AS nav, round(be.nav, 4) AS benchmark_nav FROM eq e JOIN be ON e.bar_ts = be.bar_ts")
def _(s, d):
    return K.against_benchmark(equity(s, d), K.benchmark_curve(X.daily_bars(s, d), "AF", 10_000.0)).select("strategy_id", "bar_ts", r("nav", 4), r("benchmark_nav", 4))


@query("k15_predicted_vs_actual", "rets", f", {_PRED} SELECT symbol, round(max(greatest(abs(exp(y_pred_logret) - 1), abs(exp(y_true_logret) - 1))), 8) AS axis, count(*) AS n FROM pr GROUP BY symbol")
def _(s, d):
    a, b = F.abs(F.exp("y_pred_logret") - 1), F.abs(F.exp("y_true_logret") - 1)
    return predictions(s, d).groupBy("symbol").agg(F.round(F.max(F.greatest(a, b)), 8).alias("axis"), F.count("*").alias("n"))


# L: monitoring
@query("l01_alerts", "rets", _EQ + f", {_SUM}, u AS (UNPIVOT (SELECT strategy_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _METRICS)} FROM su) ON {', '.join(_METRICS)} INTO NAME metric VALUE value), li AS (SELECT * FROM (VALUES ('max_drawdown', 0.001::DOUBLE), ('volatility', 0.01::DOUBLE)) AS t(metric, max_value)) SELECT strategy_id, metric, round(value, 5) AS value, max_value FROM u JOIN li USING (metric) WHERE value > max_value")
def _(s, d):
    limits = s.createDataFrame([("max_drawdown", 0.001), ("volatility", 0.01)], "metric string, max_value double")
    return L.alerts(K.long_metrics(K.performance_summary(equity(s, d), "1d", 10_000.0)), limits).select("strategy_id", "metric", r("value", 5), "max_value")


@query("l02_forecast_summary", "rets", f", {_PRED} SELECT ts, count(*) AS assets, round(median(exp(y_pred_logret) - 1), 8) AS median_mu FROM pr GROUP BY ts")
def _(s, d):
    p = predictions(s, d).withColumn("mu", F.exp("y_pred_logret") - 1)
    return L.forecast_summary(p).select("ts", "assets", r("median_mu"))


@query("l04_quality_alerts", "hbars", "SELECT symbol, count(*) AS missing FROM (SELECT symbol, unnest(generate_series(p + INTERVAL 1 HOUR, bar_ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) FROM (SELECT symbol, bar_ts, lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS p FROM hbars) WHERE bar_ts > p + INTERVAL 1 HOUR) GROUP BY symbol")
def _(s, d):
    return L.quality_alerts(G.quality_report(X.event_bars(s, d, "1h"), "1h")).select("symbol", "missing")


@query("l05_nav_jumps", "rets", _EQ + " SELECT strategy_id, bar_ts, round(ret, 8) AS change FROM ret2 WHERE abs(ret) > 0.002")
def _(s, d):
    return L.nav_jumps(equity(s, d), 0.002).select("strategy_id", "bar_ts", r("change"))


@query("l06_monitoring_records", "rets", f", {_COV} SELECT epoch_us(bar_ts) // 1000 AS ts, round(sqrt(sum(x)), 6) AS cov_turnover FROM (SELECT bar_ts, power(cov - lag(cov) OVER (PARTITION BY sym_i, sym_j ORDER BY bar_ts), 2) * CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END AS x FROM c250) GROUP BY bar_ts")
def _(s, d):
    records = L.monitoring_records(V.cov_turnover(V.rolling_covariance(rets(s, d))))
    told = F.from_json("record", "struct<ts: long, metrics: struct<cov_turnover: double>>")
    return records.select(told.alias("t")).select("t.ts", F.round("t.metrics.cov_turnover", 6).alias("cov_turnover"))
