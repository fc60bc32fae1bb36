"""Risk model: EWMA and GARCH variances, covariances by pair, losses and diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.operators.grid import by_symbol
from barspan.operators.scan import affine_scan, seeded


def ewma_variance(returns: DataFrame, decay: float = 0.94, window: int = 30, floor: float = 1e-10, out: str = "ewma_var") -> DataFrame:
    """Exponentially weighted variance, started by the sample variance of the first `window` returns (squares move it after)."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    at = F.count("ret").over(by_symbol())
    b = seeded(F.col("ret"), at, window, F.var_samp("ret").over(w), (1 - decay) * F.col("ret") * F.col("ret"))
    rows = affine_scan(returns.withColumn("_b", b), "_b", decay, out).drop("_b")
    return rows.withColumn(out, F.when(F.col(out).isNotNull(), F.greatest(F.col(out), F.lit(floor))))


def garch_variance(returns: DataFrame, omega: float = 1e-6, alpha: float = 0.05, beta: float = 0.9, window: int = 60, out: str = "garch_var") -> DataFrame:
    """GARCH(1,1) filtered over the last `window` returns from their sample variance: a scan less what left the window."""
    rows = affine_scan(returns.withColumn("_b", F.when(F.col("ret").isNotNull(), omega + alpha * F.col("ret") * F.col("ret"))), "_b", beta, "_s").drop("_b")
    valid = Window.partitionBy("symbol", F.col("ret").isNotNull()).orderBy("bar_ts")
    gone = F.lag("_s", window).over(valid)
    seed = F.var_samp("ret").over(valid.rowsBetween(-(window - 1), 0))
    full = F.col("ret").isNotNull() & (F.count("ret").over(by_symbol()) >= window)
    return rows.withColumn(out, F.when(full, F.col("_s") - beta**window * F.coalesce(gone, F.lit(0.0)) + beta**window * seed)).drop("_s")


def chosen_variance(garch: str = "garch_var", ewma: str = "ewma_var") -> Column:
    return F.coalesce(F.when(F.col(garch).isNotNull(), F.greatest(F.lit(1e-10), F.least(F.lit(1e2), F.col(garch)))), F.col(ewma), F.lit(1e-10))


def vol_losses(variances: DataFrame, var: str, window: int = 200) -> DataFrame:
    """Squared error and QLIKE of a variance against the squared return of its bar, and their means over the last bars."""
    real, v = F.col("ret") * F.col("ret"), F.greatest(F.col(var), F.lit(1e-12))
    rows = variances.filter(F.col("ret").isNotNull() & F.col(var).isNotNull()).withColumns({"mse": F.pow(F.col(var) - real, F.lit(2.0)), "qlike": F.ln(v) + real / v})
    w = by_symbol().rowsBetween(-(window - 1), 0)
    return rows.withColumns({"mse_avg": F.avg("mse").over(w), "qlike_avg": F.avg("qlike").over(w)})


def pair_returns(returns: DataFrame) -> DataFrame:
    """Returns of every pair of symbols i <= j at the same time, by an equi-join on time; a column var comes along for i."""
    valid = returns.filter("ret is not null")
    var = [F.col("var").alias("var_i")] if "var" in returns.columns else []
    a = valid.select("bar_ts", F.col("symbol").alias("sym_i"), F.col("ret").alias("r_i"), *var)
    b = valid.select("bar_ts", F.col("symbol").alias("sym_j"), F.col("ret").alias("r_j"))
    return a.join(b, "bar_ts").filter("sym_i <= sym_j")


def rolling_covariance(returns: DataFrame, window: int = 250) -> DataFrame:
    """(bar_ts, sym_i, sym_j, cov, n): sample covariance over the last `window` common bars of each pair.

    With one common bar there is no sample covariance: the diagonal falls back to the variance chosen for the symbol, where
    returns have it as a column var (see chosen_variance), and to the squared return where they don't; others to 0.
    """
    w = Window.partitionBy("sym_i", "sym_j").orderBy("bar_ts").rowsBetween(-(window - 1), 0)
    n = F.count("*").over(w)
    pairs = pair_returns(returns)
    chosen = F.col("var_i") if "var_i" in pairs.columns else F.col("r_i") * F.col("r_i")
    cov = F.when(n > 1, F.covar_samp("r_i", "r_j").over(w)).otherwise(F.when(F.col("sym_i") == F.col("sym_j"), chosen).otherwise(0.0))
    return pairs.select("bar_ts", "sym_i", "sym_j", cov.alias("cov"), n.alias("n"))


def model_ready(cov: DataFrame, window: int = 60) -> DataFrame:
    """(bar_ts, pairs, ready): whether every pair of a bar has a covariance over at least `window` common bars."""
    return cov.groupBy("bar_ts").agg(F.count("*").alias("pairs"), (F.min("n") >= window).alias("ready"))


def full_matrix(cov: DataFrame) -> DataFrame:
    """Both triangles of a covariance kept for i <= j."""
    swapped = [F.col({"sym_i": "sym_j", "sym_j": "sym_i"}.get(c, c)).alias(c) for c in cov.columns]
    return cov.unionByName(cov.filter("sym_i < sym_j").select(*swapped))


def cov_for_universe(cov: DataFrame, universe: DataFrame) -> DataFrame:
    """Entries among the symbols of each time's universe (bar_ts, symbol), only where all of them are there."""
    u = universe.select("bar_ts", "symbol")
    kept = full_matrix(cov).join(u.withColumnRenamed("symbol", "sym_i"), ["bar_ts", "sym_i"]).join(u.withColumnRenamed("symbol", "sym_j"), ["bar_ts", "sym_j"])
    wanted = u.groupBy("bar_ts").agg((F.count("*") * F.count("*")).alias("_want"))
    whole = kept.groupBy("bar_ts").agg(F.count("*").alias("_have")).join(wanted, "bar_ts").filter("_have = _want").select("bar_ts")
    return kept.join(whole, "bar_ts", "left_semi")


def cov_turnover(cov: DataFrame) -> DataFrame:
    """(bar_ts, cov_turnover): Frobenius norm of the change from the bar before, over pairs that both bars have."""
    w = Window.partitionBy("sym_i", "sym_j").orderBy("bar_ts")
    change = F.col("cov") - F.lag("cov").over(w)
    d = cov.select("bar_ts", (change * change * F.when(F.col("sym_i") == F.col("sym_j"), 1).otherwise(2)).alias("d"))
    return d.groupBy("bar_ts").agg(F.sqrt(F.sum("d")).alias("cov_turnover"))


def _matrices(pdf: pd.DataFrame, value: str) -> tuple[list[str], np.ndarray]:
    m = pdf.pivot(index="sym_i", columns="sym_j", values=value)
    return list(m.index), m.to_numpy()


def mahalanobis(cov: DataFrame, returns: DataFrame) -> DataFrame:
    """(bar_ts, n, d2): squared distance of a bar's returns under its covariance, by pseudo-inverse; bars run apart."""
    rows = full_matrix(cov.select("bar_ts", "sym_i", "sym_j", "cov")).join(returns.filter("ret is not null").select("bar_ts", F.col("symbol").alias("sym_i"), "ret"), ["bar_ts", "sym_i"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _matrices(pdf, "cov")
        r = pdf.drop_duplicates("sym_i").set_index("sym_i")["ret"].reindex(names).to_numpy()
        d2 = float(r @ np.linalg.pinv(m) @ r) if m.shape[0] == m.shape[1] and np.isfinite(m).all() else None
        return pd.DataFrame({"bar_ts": [pdf["bar_ts"].iloc[0]], "n": [len(names)], "d2": [d2]})

    return rows.groupBy("bar_ts").applyInPandas(one, "bar_ts timestamp_ntz, n long, d2 double")


def malv(distances: DataFrame, window: int = 200) -> DataFrame:
    # One row a bar, so the order over bars is global and small beside the bars.
    return distances.withColumn("malv", F.avg(F.col("d2") - F.col("n")).over(Window.orderBy("bar_ts").rowsBetween(-(window - 1), 0)))


def portfolio_variance(cov: DataFrame, weights: DataFrame, out: str = "variance") -> DataFrame:
    """(portfolio, bar_ts, variance): w' cov w of weights (portfolio, symbol, weight) on every bar."""
    w = weights.select("portfolio", F.col("symbol").alias("sym_i"), F.col("weight").alias("w_i"))
    v = weights.select("portfolio", F.col("symbol").alias("sym_j"), F.col("weight").alias("w_j"))
    terms = cov.join(w, "sym_i").join(v, ["portfolio", "sym_j"])
    return terms.groupBy("portfolio", "bar_ts").agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("cov") * F.when(F.col("sym_i") == F.col("sym_j"), 1).otherwise(2)).alias(out))


def portfolio_cov_loss(forecast: DataFrame, realized: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean squared error and QLIKE of portfolio variances under two covariances, by bar."""
    both = portfolio_variance(forecast, weights, "f").join(portfolio_variance(realized, weights, "r"), ["portfolio", "bar_ts"])
    qlike = F.when((F.col("f") > 0) & (F.col("r") > 0), F.ln("f") + F.col("r") / F.col("f"))
    return both.groupBy("bar_ts").agg(F.avg(F.pow(F.col("f") - F.col("r"), F.lit(2.0))).alias("cov_port_mse"), F.avg(qlike).alias("cov_port_qlike"))


def eigen_cov_loss(forecast: DataFrame, realized: DataFrame, n_random: int = 20, seed: int = 42) -> DataFrame:
    """The same losses over the forecast's eigenvectors and n_random seeded portfolios; bars run apart."""
    rows = full_matrix(forecast.select("bar_ts", "sym_i", "sym_j", "cov")).join(full_matrix(realized.select("bar_ts", "sym_i", "sym_j", F.col("cov").alias("real"))), ["bar_ts", "sym_i", "sym_j"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, f = _matrices(pdf, "cov")
        _, r = _matrices(pdf, "real")
        if not (np.isfinite(f).all() and np.isfinite(r).all()):  # a pair lacks its covariance
            return pd.DataFrame({"bar_ts": [pdf["bar_ts"].iloc[0]], "cov_port_mse": [None], "cov_port_qlike": [None]})
        w = np.concatenate([np.linalg.eigh(f)[1].T, np.random.default_rng(seed).normal(size=(n_random, len(names)))])
        w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-12
        fv, rv = np.einsum("ki,ij,kj->k", w, f, w), np.einsum("ki,ij,kj->k", w, r, w)
        ok = (fv > 0) & (rv > 0)
        qlike = float((np.log(fv[ok]) + rv[ok] / fv[ok]).mean()) if ok.any() else None
        return pd.DataFrame({"bar_ts": [pdf["bar_ts"].iloc[0]], "cov_port_mse": [float(((fv - rv) ** 2).mean())], "cov_port_qlike": [qlike]})

    return rows.groupBy("bar_ts").applyInPandas(one, "bar_ts timestamp_ntz, cov_port_mse double, cov_port_qlike double")


def diagnostics_rollup(losses: DataFrame) -> DataFrame:
    """Mean over symbols of each symbol's latest rolling means."""
    last = losses.groupBy("symbol").agg(F.max_by("mse_avg", "bar_ts").alias("m"), F.max_by("qlike_avg", "bar_ts").alias("q"))
    return last.agg(F.avg("m").alias("vol_mse_avg"), F.avg("q").alias("vol_qlike_avg"), F.count("*").alias("symbols"))


def nav_volatility(equity: DataFrame, key: str = "strategy_id", ts: str = "bar_ts", window: int = 200) -> DataFrame:
    """Sample deviation of the last NAV changes, 0 where fewer than five values are there."""
    w = Window.partitionBy(key).orderBy(ts)
    r = equity.withColumn("_r", F.col("nav") / F.lag("nav").over(w) - 1)
    return r.withColumn("nav_vol", F.when(F.count("*").over(w) < 5, 0.0).otherwise(F.stddev_samp("_r").over(w.rowsBetween(-(window - 2), 0)))).drop("_r")
