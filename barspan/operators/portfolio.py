"""Portfolio construction: mean-variance weights, caps, Kelly scaling, costs, orders and the rebalance path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import clip, fee, floor_to_step

KEYS = ["strategy_id", "bar_ts"]
WEIGHTS = "strategy_id string, bar_ts timestamp_ntz, symbol string, weight double"


def by_bar():
    return Window.partitionBy(*KEYS)


def solve_weights(mu: np.ndarray, cov: np.ndarray, prev: np.ndarray | None, gamma: float, lam: float, horizon: float, bps: np.ndarray) -> np.ndarray:
    """Closed form of the mean-variance weights with a quadratic pull to the previous ones."""
    k = np.ones(len(mu))
    if prev is not None and lam > 0:
        k = 1 + np.maximum(bps, 0) / 1e4
        mu = mu + 2 * lam / horizon * k * prev
    return np.linalg.pinv(gamma * cov + 2 * lam * np.diag(k)) @ mu


def mean_variance_weights(mu: DataFrame, cov: DataFrame, prev: DataFrame | None = None, gamma: float = 5.0, lam: float = 0.1, horizon: float = 1.0, bps: float = 5.0) -> DataFrame:
    """(strategy_id, bar_ts, symbol, weight): mu (strategy_id, bar_ts, symbol, mu), cov with both triangles by bar.

    Every strategy and bar is solved apart; a bar whose covariance lacks a pair of its symbols is left out. A missing mu is 0.
    """
    rows = mu.select(*KEYS, F.col("symbol").alias("sym_i"), "mu").join(cov.select("bar_ts", "sym_i", "sym_j", "cov"), ["bar_ts", "sym_i"])
    rows = rows.join(mu.select(*KEYS, F.col("symbol").alias("sym_j")), [*KEYS, "sym_j"], "left_semi")
    has_prev = prev is not None
    rows = rows.join(prev.select(*KEYS, F.col("symbol").alias("sym_i"), F.col("weight").alias("prev")), [*KEYS, "sym_i"], "left") if has_prev else rows.withColumn("prev", F.lit(None).cast("double"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="sym_i", columns="sym_j", values="cov")
        if m.shape[0] != m.shape[1] or not np.isfinite(m.to_numpy()).all():
            return pd.DataFrame(columns=[*KEYS, "symbol", "weight"])
        per = pdf.drop_duplicates("sym_i").set_index("sym_i").reindex(m.index)
        p = per["prev"].fillna(0.0).to_numpy() if has_prev and per["prev"].notna().any() else None
        w = solve_weights(per["mu"].fillna(0.0).to_numpy(), m.to_numpy(), p, gamma, lam, horizon, np.full(len(per), bps))
        return pd.DataFrame({"strategy_id": pdf["strategy_id"].iloc[0], "bar_ts": pdf["bar_ts"].iloc[0], "symbol": m.index, "weight": w})

    return rows.groupBy(*KEYS).applyInPandas(one, WEIGHTS)


def apply_exposure_caps(weights: DataFrame, lo: float = -0.3, hi: float = 0.3, max_gross: float = 1.2, max_net: float = 0.25, gross: bool = True) -> DataFrame:
    """Clip each weight, scale to the gross cap, shift equally to the net cap, clip again."""
    w = weights.withColumn("weight", clip(F.col("weight"), lo, hi))
    if gross:
        g = F.sum(F.abs("weight")).over(by_bar())
        w = w.withColumn("weight", F.col("weight") * F.when(g > max_gross, max_gross / g).otherwise(1.0))
    net, n = F.sum("weight").over(by_bar()), F.count("*").over(by_bar())
    w = w.withColumn("weight", F.col("weight") - F.when(F.abs(net) > max_net, (net - F.signum(net) * max_net) / n).otherwise(0.0))
    return w.withColumn("weight", clip(F.col("weight"), lo, hi))


def kelly_fraction(weights: DataFrame, mu: DataFrame, cov: DataFrame, most: float = 2.0) -> DataFrame:
    """(strategy_id, bar_ts, mu_p, var_p, f_star): mu'w over w' cov w, within [0, most]; 0 where the variance isn't positive."""
    m = weights.join(mu, [*KEYS, "symbol"], "left").groupBy(*KEYS).agg(F.sum(F.coalesce("mu", F.lit(0.0)) * F.col("weight")).alias("mu_p"))
    a = weights.select(*KEYS, F.col("symbol").alias("sym_i"), F.col("weight").alias("w_i"))
    b = weights.select(*KEYS, F.col("symbol").alias("sym_j"), F.col("weight").alias("w_j"))
    v = cov.join(a, ["bar_ts", "sym_i"]).join(b, [*KEYS, "sym_j"]).groupBy(*KEYS).agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("cov")).alias("var_p"))
    f = F.when(F.col("var_p") > 0, clip(F.col("mu_p") / F.col("var_p"), 0.0, most)).otherwise(0.0)
    return m.join(v, KEYS).withColumn("f_star", f)


def kelly_lambda(drawdown: Column, vol: Column, base: float = 0.5, ladder=((0.05, 0.4), (0.1, 0.25), (0.2, 0.1)), vol_limit: float = 0.05) -> Column:
    """The fraction of Kelly: lowered at each drawdown passed, damped by volatility above its limit."""
    lam = F.least(F.lit(base), *[F.when(drawdown >= at, F.lit(x)) for at, x in ladder])
    return F.when(vol > 0, lam / (1 + F.greatest(F.lit(0.0), vol - vol_limit))).otherwise(lam)


def max_constraint_scale(weights: DataFrame, lo: float = -0.3, hi: float = 0.3, max_gross: float = 1.2, max_net: float = 0.25) -> DataFrame:
    """(strategy_id, bar_ts, scale): the largest factor that keeps each name, gross and net within their caps."""
    w = F.col("weight")
    name = F.min(F.when(w > 0, hi / F.nullif(w, F.lit(0.0))).when(w < 0, lo / F.nullif(w, F.lit(0.0))))
    gross, net = max_gross / F.nullif(F.sum(F.abs(w)), F.lit(0.0)), max_net / F.nullif(F.abs(F.sum(w)), F.lit(0.0))
    return weights.groupBy(*KEYS).agg(F.coalesce(F.least(name, gross, net), F.lit(0.0)).alias("scale"))


def scale_weights(weights: DataFrame, *scales: DataFrame) -> DataFrame:
    """Weights times the least of the given (strategy_id, bar_ts, scale)."""
    out, names = weights, []
    for i, s in enumerate(scales):
        out = out.join(s.select(*KEYS, F.col("scale").alias(f"_s{i}")), KEYS)
        names.append(f"_s{i}")
    factor = F.least(*names) if len(names) > 1 else F.col(names[0])
    return out.withColumn("weight", F.col("weight") * factor).drop(*names)


def weight_changes(prev: DataFrame, target: DataFrame) -> DataFrame:
    """Previous and target weights over the union of their symbols, 0 where absent."""
    p, t = prev.select(*KEYS, "symbol", F.col("weight").alias("w_prev")), target.select(*KEYS, "symbol", F.col("weight").alias("w_new"))
    both = p.join(t, [*KEYS, "symbol"], "full_outer")
    return both.select(*KEYS, "symbol", F.coalesce("w_prev", F.lit(0.0)).alias("w_prev"), F.coalesce("w_new", F.lit(0.0)).alias("w_new"))


def lagged_weights(weights: DataFrame) -> DataFrame:
    """Each bar's weights as they stand on the strategy's next bar."""
    bars = weights.select(*KEYS).distinct()
    nxt = bars.withColumn("next_ts", F.lead("bar_ts").over(Window.partitionBy("strategy_id").orderBy("bar_ts"))).filter("next_ts is not null")
    return weights.join(nxt, KEYS).select("strategy_id", F.col("next_ts").alias("bar_ts"), "symbol", "weight")


def turnover(weights: DataFrame) -> DataFrame:
    """(strategy_id, bar_ts, turnover): sum of absolute changes from the bar before; the first bar counts in full."""
    known = weights.select(*KEYS).distinct()
    c = weight_changes(lagged_weights(weights), weights)
    return c.groupBy(*KEYS).agg(F.sum(F.abs(F.col("w_new") - F.col("w_prev"))).alias("turnover")).join(known, KEYS, "left_semi")


def lagged_covariance(cov: DataFrame) -> DataFrame:
    """Each bar's covariance as it stands on the next bar."""
    # One row a bar, so the order over bars is global and small beside the pairs.
    nxt = cov.select("bar_ts").distinct().withColumn("next_ts", F.lead("bar_ts").over(Window.orderBy("bar_ts"))).filter("next_ts is not null")
    return cov.join(nxt, "bar_ts").select(F.col("next_ts").alias("bar_ts"), "sym_i", "sym_j", "cov")


def covariance_turnover(mu: DataFrame, cov: DataFrame, prev: DataFrame | None = None, **params) -> DataFrame:
    """(strategy_id, bar_ts, turnover_sigma): sum of absolute differences of a bar's weights under its own and the bar before's covariance.

    Null where the bar before lacks a symbol of the bar.
    """
    old, new = mean_variance_weights(mu, lagged_covariance(cov), prev, **params), mean_variance_weights(mu, cov, prev, **params)
    both = new.select(*KEYS, "symbol", F.col("weight").alias("w_new")).join(old.select(*KEYS, "symbol", F.col("weight").alias("w_old")), [*KEYS, "symbol"], "left")
    total = F.sum(F.abs(F.col("w_new") - F.col("w_old")))
    return both.groupBy(*KEYS).agg(F.when(F.count("w_old") == F.count("*"), total).alias("turnover_sigma"))


def expected_costs(changes: DataFrame, nav: float, fee_rate: float = 0.0004, bps: float = 5.0) -> DataFrame:
    notional = F.abs(F.col("w_new") - F.col("w_prev")) * nav
    c = changes.groupBy(*KEYS).agg(F.sum(fee(notional, fee_rate)).alias("fee_cost"), F.sum(notional * bps / 1e4).alias("slippage_cost"))
    total = F.col("fee_cost") + F.col("slippage_cost")
    return c.withColumns({"total_cost": total, "total_cost_bp": F.try_divide(total, F.lit(nav)) * 1e4})


def apply_cost_budget(changes: DataFrame, costs: DataFrame, budget_bp: float) -> DataFrame:
    """Shrink the changes of bars whose expected cost is above the budget; result as weights."""
    s = costs.select(*KEYS, F.when(F.col("total_cost_bp") > budget_bp, budget_bp / F.col("total_cost_bp")).otherwise(1.0).alias("_s"))
    return changes.join(s, KEYS).select(*KEYS, "symbol", (F.col("w_prev") + (F.col("w_new") - F.col("w_prev")) * F.col("_s")).alias("weight"))


def generate_orders(changes: DataFrame, prices: DataFrame, filters: DataFrame, nav: float, least_notional: float = 5.0) -> DataFrame:
    """Orders from weight changes; skip_reason says why there is none. filters: symbol, step_size, min_qty, min_notional, multiplier."""
    rows = changes.join(prices.select("bar_ts", "symbol", F.col("close").alias("price")), ["bar_ts", "symbol"], "left").join(filters, "symbol", "left")
    delta = F.col("w_new") - F.col("w_prev")
    rows = rows.withColumns({"_notional": delta * nav, "_least": F.greatest(F.lit(least_notional), F.coalesce("min_notional", F.lit(0.0))), "_mult": F.coalesce("multiplier", F.lit(1.0))})
    raw = F.try_divide(F.abs("_notional"), F.col("price") * F.col("_mult"))
    rows = rows.withColumn("quantity", F.when(F.col("price") > 0, floor_to_step(raw, F.coalesce("step_size", F.lit(0.0)))))
    rows = rows.withColumns({"side": F.when(delta > 0, "buy").otherwise("sell"), "notional": F.col("quantity") * F.col("price") * F.col("_mult")})
    reason = (
        F.when(F.abs(delta) < 1e-4, "small_change").when(F.col("price").isNull() | (F.col("price") <= 0), "no_price").when(F.abs("_notional") < F.col("_least"), "min_notional")
        .when((F.col("quantity") < F.coalesce("min_qty", F.lit(0.0))) | (F.col("quantity") <= 0), "min_qty").when(F.col("notional") < F.col("_least"), "min_notional")
    )
    return rows.select(*KEYS, "symbol", "side", "quantity", "notional", "price", F.col("w_new").alias("target_weight"), F.col("w_prev").alias("current_weight"), reason.alias("skip_reason"))


def validate_predictions(predictions: DataFrame, symbols: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, first_ts, last_ts, covered): whether each wanted symbol's predictions span the window; absent ones are not covered."""
    s = predictions.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    ok = (F.col("first_ts") <= F.lit(start).cast("timestamp_ntz")) & (F.col("last_ts") >= F.lit(end).cast("timestamp_ntz"))
    return symbols.join(s, "symbol", "left").withColumn("covered", F.coalesce(ok, F.lit(False)))


def realized_slippage(executions: DataFrame, mids: DataFrame) -> DataFrame:
    """(bar_ts, slippage_bp): notional-weighted slippage of fills (array of price, qty) against mid prices."""
    qty = F.aggregate("fills", F.lit(0.0), lambda a, x: a + x["qty"])
    paid = F.aggregate("fills", F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])
    rows = executions.filter(F.size("fills") > 0).join(mids.filter("mid > 0"), ["bar_ts", "symbol"])
    slip = (paid / F.greatest(F.lit(1e-9), qty) - F.col("mid")) / F.col("mid") * F.when(F.col("side") == "buy", 1).otherwise(-1)
    rows = rows.withColumns({"_n": F.abs(F.col("quantity") * F.col("mid")), "_s": slip})
    return rows.groupBy("bar_ts").agg((F.try_divide(F.sum(F.col("_s") * F.col("_n")), F.sum("_n")) * 1e4).alias("slippage_bp"))


def execution_status(executions: DataFrame) -> DataFrame:
    """(bar_ts, status, failed): completed where every order succeeded, else partial, with the failed symbols."""
    return executions.groupBy("bar_ts").agg(F.when(F.bool_and("success"), "completed").otherwise("partial").alias("status"), F.sort_array(F.collect_list(F.when(~F.col("success"), F.col("symbol")))).alias("failed"))


def solve_terms(inputs: DataFrame, grid: DataFrame, horizon: float = 1.0, bps: float = 5.0) -> DataFrame:
    """grid x inputs with what the solution of a bar needs besides the previous weights; every row is solved apart.

    first: weights of a path without previous weights; base and pull: with previous ones, they are base + pull @ prev. All
    three are null where the covariance is not whole.
    """

    def solve(batches):
        for pdf in batches:
            first, base, pull = [], [], []
            for row in pdf.itertuples():
                n = len(row.symbols)
                if row.cov is None or len(row.cov) != n * n or not np.isfinite(np.array(row.cov, dtype=float)).all():
                    first.append(None), base.append(None), pull.append(None)
                    continue
                mu, cov, k = np.nan_to_num(np.array(row.mu, dtype=float)), np.array(row.cov).reshape(n, n), np.full(n, 1 + max(bps, 0.0) / 1e4)
                inverse = np.linalg.pinv(row.gamma * cov + 2 * row.lam * np.diag(k))
                first.append(solve_weights(mu, cov, None, row.gamma, row.lam, horizon, np.full(n, bps)))
                base.append(inverse @ mu if row.lam > 0 else first[-1])
                pull.append((inverse * (2 * row.lam / horizon * k)).ravel() if row.lam > 0 else np.zeros(0))
            yield pdf.assign(first=first, base=base, pull=pull)

    # The grid is small by construction: a row for each parameter set.
    rows = inputs.crossJoin(F.broadcast(grid)).repartition("strategy_id", "bar_ts")
    extra = ", ".join(f"{c} array<double>" for c in ("first", "base", "pull"))
    return rows.mapInPandas(solve, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", " + extra)


def _clamp(w: np.ndarray, lo: float, hi: float, max_net: float) -> np.ndarray:
    net = w.sum()
    return np.clip(w - (net - np.sign(net) * max_net) / len(w) if abs(net) > max_net else w, lo, hi)


PATH = WEIGHTS + ", nav double, status string, reason string, kelly double, scale double, limited boolean, side string, quantity double, notional double, skip_reason string"


class _Path:
    """One parameter set's state from bar to bar: what is held, and the values of which drawdown and volatility are taken."""

    def __init__(self, nav, lo, hi, max_gross, max_net, most, base, ladder, vol_limit, fee_rate, bps, least_notional):
        self.nav, self.held, self.peak, self.navs = nav, {}, 0.0, []
        self.lo, self.hi, self.max_gross, self.max_net, self.most, self.base, self.ladder = lo, hi, max_gross, max_net, most, base, ladder
        self.vol_limit, self.rate, self.least_notional = vol_limit, fee_rate + bps / 1e4, least_notional

    def kelly(self, w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> float:
        self.peak, self.navs = max(self.peak, self.nav), [*self.navs[-199:], self.nav]
        drawdown = max(0.0, (self.peak - self.nav) / self.peak) if self.peak > 0 else 0.0
        x = np.array(self.navs)
        vol = float(np.std(np.diff(x) / x[:-1], ddof=1)) if len(x) >= 5 else 0.0
        lam = min([self.base, *[v for at, v in self.ladder if drawdown >= at]])
        lam = lam / (1 + max(0.0, vol - self.vol_limit)) if vol > 0 else lam
        var = float(w @ cov @ w)
        return lam * min(self.most, max(0.0, float(mu @ w) / var)) if var > 0 else 0.0

    def constraint(self, w: np.ndarray) -> float:
        gross, net = np.abs(w).sum(), abs(w.sum())
        caps = [*(self.hi / w[w > 0]), *(self.lo / w[w < 0])] + ([self.max_gross / gross] if gross > 0 else []) + ([self.max_net / net] if net > 0 else [])
        return float(min(caps, default=0.0))

    def order(self, delta: float, price, step, min_qty, min_notional, multiplier) -> tuple:
        """(side, quantity, notional, why there is no order)."""
        side, notional, least = "buy" if delta > 0 else "sell", delta * self.nav, max(self.least_notional, min_notional)
        if abs(delta) < 1e-4:
            return None, None, None, "small_change"
        if not price > 0:
            return side, None, None, "no_price"
        raw = abs(notional) / (price * multiplier)
        quantity = float(np.floor((raw + 1e-12) / step) * step) if step > 0 else raw
        why = "min_notional" if abs(notional) < least else "min_qty" if quantity < min_qty or quantity <= 0 else "min_notional" if quantity * price * multiplier < least else None
        return side, quantity, quantity * price * multiplier, why

    def bar(self, row) -> list[tuple]:
        names, n = list(row.symbols), len(row.symbols)
        at = {s: i for i, s in enumerate(names)}
        self.nav *= 1 + sum(w * row.rets[at[s]] for s, w in self.held.items() if s in at and np.isfinite(row.rets[at[s]]))
        union = [*names, *[s for s in self.held if s not in at]]
        prev = np.array([self.held.get(s, 0.0) for s in union])
        none = (None, None, None, None)

        def skipped(reason, *rest, orders=None):
            rest = rest or (None, None, None)
            return [(row.strategy_id, row.bar_ts, s, float(w), float(self.nav), "skipped", reason, *rest, *(orders[i] if orders else none)) for i, (s, w) in enumerate(zip(union, prev, strict=True))]

        mu = np.array(row.mu, dtype=float)
        if not np.isfinite(mu).any():
            return skipped("empty forecast")
        if row.first is None:
            return skipped("missing covariance")
        mu, cov = np.nan_to_num(mu), np.array(row.cov, dtype=float).reshape(n, n)
        w = np.array(row.base) + (np.array(row.pull).reshape(n, n) @ prev[:n] if len(row.pull) else 0.0) if self.held else np.array(row.first)
        w = np.clip(w, self.lo, self.hi)
        w = _clamp(w * min(1.0, self.max_gross / max(np.abs(w).sum(), 1e-12)), self.lo, self.hi, self.max_net)
        kelly, cap = self.kelly(w, mu, cov), self.constraint(w)
        scale = min(kelly, cap)
        target = np.concatenate([_clamp(w * scale, self.lo, self.hi, self.max_net), np.zeros(len(union) - n)])
        kept, cost_bp = names, np.abs(target - prev).sum() * self.rate * 1e4
        limited = bool(row.budget_bp > 0 and cost_bp > row.budget_bp)
        if limited:
            kept, target = union, _clamp(prev + (target - prev) * row.budget_bp / cost_bp, self.lo, self.hi, self.max_net)
        per = [[float(x) for x in v] for v in (row.prices, row.step_size, row.min_qty, row.min_notional, row.multiplier)]
        orders = [self.order(float(target[i] - prev[i]), *([v[i] for v in per] if i < n else (np.nan, 0.0, 0.0, 0.0, 1.0))) for i in range(len(union))]
        if not any(o[1] is not None and o[3] is None for o in orders):
            return skipped("portfolio already aligned", kelly, scale, limited, orders=orders)
        self.held = {s: float(target[i]) for i, s in enumerate(kept)}
        return [(row.strategy_id, row.bar_ts, s, float(x), float(self.nav), "completed", None, kelly, scale, limited, *o) for s, x, o in zip(union, target, orders, strict=True)]


def rebalance_path(
    inputs: DataFrame, grid: DataFrame, nav: float = 10_000.0, lo: float = -0.3, hi: float = 0.3, max_gross: float = 1.2, max_net: float = 0.25, most: float = 2.0,
    base: float = 0.5, ladder=((0.05, 0.4), (0.1, 0.25), (0.2, 0.1)), vol_limit: float = 0.05, fee_rate: float = 0.0004, bps: float = 5.0, least_notional: float = 5.0,
) -> DataFrame:
    """Rebalancing with feedback of the weights held, for every parameter set of grid at once.

    inputs: one row a bar with arrays of symbols, mu, rets, prices, step_size, min_qty, min_notional, multiplier, and the
    row-major cov, null or short where pairs are missing; grid: strategy_id, gamma, lam, budget_bp (no budget at 0).
    A bar moves the NAV by what is held, then runs the chain: weights and caps, Kelly fraction on drawdown and volatility,
    largest constraint scale, net clamp, cost budget, orders. Bars that change nothing are skipped with a reason ('empty
    forecast', 'missing covariance', 'portfolio already aligned'), as rows too; they keep what is held.
    Result: a row for each bar and symbol of the bar or held, with weight, nav, status, reason, kelly, scale, limited
    (by the budget), side, quantity, notional and skip_reason of its order.
    Bars are solved apart (solve_terms); then each parameter set is one task that reads its sorted bars as a stream of
    batches and holds one state.
    """

    def fold(batches):
        path, of = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if path is None or row.strategy_id != of:
                    path, of = _Path(nav, lo, hi, max_gross, max_net, most, base, ladder, vol_limit, fee_rate, bps, least_notional), row.strategy_id
                out += path.bar(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PATH.split(", ")])

    return solve_terms(inputs, grid, bps=bps).repartition("strategy_id").sortWithinPartitions("strategy_id", "bar_ts").mapInPandas(fold, PATH)
