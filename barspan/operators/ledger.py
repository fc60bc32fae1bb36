"""Fills to positions, cash, funding and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import fee, slipped_price
from barspan.operators.scan import varying_scan


def by_position():
    return Window.partitionBy("account", "symbol").orderBy("ts", "seq")


def price_fills(fills: DataFrame, bps: float = 5.0, fee_rate: float = 0.0004) -> DataFrame:
    """Add fill_px, signed_qty, notional and fee."""
    px = slipped_price(F.col("price"), F.col("side"), F.lit(bps))
    sign = F.when(F.lower("side") == "buy", 1).otherwise(-1)
    return fills.withColumns({"fill_px": px, "signed_qty": F.col("qty") * sign, "notional": F.col("qty") * px, "fee": fee(F.col("qty") * px, fee_rate)})


def net_positions(priced: DataFrame) -> DataFrame:
    """Add position before and after each fill, and what it did: open, add, reduce, close or flip."""
    pos = F.sum("signed_qty").over(by_position().rowsBetween(Window.unboundedPreceding, 0))
    rows = priced.withColumn("position", pos).withColumn("prev_position", F.col("position") - F.col("signed_qty"))
    p, q = F.col("prev_position"), F.col("position")
    kind = F.when(p == 0, "open").when(q == 0, "close").when(F.signum(p) != F.signum(q), "flip").when(F.abs(q) > F.abs(p), "add").otherwise("reduce")
    return rows.withColumn("action", kind)


def position_ledger(priced: DataFrame) -> DataFrame:
    """Add entry price, realised PnL, margin and the running cash of each account and symbol.

    The entry is averaged on adding, kept on reducing and reset on a flip: a recurrence whose coefficient is the share that
    the position had before. All columns are windows of one order, behind one exchange by account and symbol.
    """
    rows = net_positions(priced)
    before, size = F.abs("prev_position"), F.abs("prev_position") + F.col("qty")
    starts = F.col("action").isin("open", "flip") | (F.row_number().over(by_position()) == 1)
    kept = F.when(starts, 0.0).when(F.col("action") == "add", before / size).otherwise(1.0)
    new = F.when(starts, F.col("fill_px")).when(F.col("action") == "add", F.col("fill_px") * F.col("qty") / size).otherwise(0.0)
    rows = varying_scan(rows, kept, new, "entry", ["account", "symbol"], ["ts", "seq"])
    before = F.lag("entry").over(by_position())
    closed = F.when(F.col("action").isin("close", "flip"), F.col("prev_position")).when(F.col("action") == "reduce", -F.col("signed_qty")).otherwise(0.0)
    rows = rows.withColumn("realized", F.coalesce((F.col("fill_px") - before) * closed, F.lit(0.0)))
    rows = rows.withColumn("margin", F.abs("position") * F.col("fill_px") / F.col("leverage"))
    flow = F.col("realized") - F.col("fee") + F.coalesce(F.lag("margin").over(by_position()), F.lit(0.0)) - F.col("margin")
    rows = rows.withColumn("_flow", flow)
    return rows.withColumn("cash", F.sum("_flow").over(by_position().rowsBetween(Window.unboundedPreceding, 0))).drop("_flow").withColumn("entry", F.when(F.col("position") != 0, F.col("entry")))


def as_of(times: DataFrame, values: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """times with the last row of values at or before ts, by a union ordered in time; values come first at equal times."""
    rows = times.withColumns({"_side": F.lit(1), **{c: F.lit(None).cast(dict(values.dtypes)[c]) for c in columns}})
    rows = rows.unionByName(values.select(*keys, ts, *columns).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).filter("_side = 1").drop("_side")


def funding_payments(positions: DataFrame, funding: DataFrame, prices: DataFrame) -> DataFrame:
    """(account, symbol, ts, payment): position times price times rate at each funding time, paid by longs where the rate is positive."""
    accounts = positions.select("account", "symbol").distinct()
    at = funding.filter(F.col("rate").isNotNull() & ~F.isnan("rate")).join(accounts, "symbol")
    held = as_of(at.select("account", "symbol", "ts", "rate"), positions.select("account", "symbol", "ts", "position"), ["account", "symbol"], "ts", ["position"])
    priced = as_of(held, prices.select("symbol", F.col("bar_ts").alias("ts"), "close"), ["symbol"], "ts", ["close"])
    return priced.filter("position is not null and position <> 0 and close is not null").select("account", "symbol", "ts", (-F.col("position") * F.col("close") * F.col("rate")).alias("payment"))


def equity_curve(ledger: DataFrame, marks: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """(account, ts, cash, unrealized, equity) at the times of marks (symbol, ts, mark): cash, margin and open profit."""
    pairs = ledger.select("account", "symbol").distinct()
    at = marks.join(pairs, "symbol")
    # Of several fills at one time the last one stands.
    last = Window.partitionBy("account", "symbol", "ts").orderBy(F.desc("seq"))
    state = ledger.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("account", "symbol", "ts", "position", F.coalesce("entry", F.lit(0.0)).alias("entry"), "cash", "margin")
    rows = as_of(at.select("account", "symbol", "ts", "mark"), state, ["account", "symbol"], "ts", ["position", "entry", "cash", "margin"])
    profit = F.coalesce((F.coalesce("mark", "entry") - F.col("entry")) * F.col("position"), F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = rows.groupBy("account", "ts").agg((F.lit(initial) + F.sum(z("cash"))).alias("cash"), F.sum(profit).alias("unrealized"), F.sum(z("margin")).alias("margin"))
    return s.withColumn("equity", F.col("cash") + F.col("margin") + F.col("unrealized"))


def exposure_report(positions: DataFrame, equity: DataFrame, max_gross: float = 1.2, max_net: float = 0.25) -> DataFrame:
    """(account, ts, gross, net, breach): exposures over equity; breaches are reported, not enforced."""
    e = positions.groupBy("account", "ts").agg(F.sum(F.abs(F.col("position") * F.col("mark"))).alias("g"), F.sum(F.col("position") * F.col("mark")).alias("n"))
    r = e.join(equity.select("account", "ts", "equity"), ["account", "ts"])
    gross, net = F.when(F.col("equity") > 0, F.col("g") / F.col("equity")), F.when(F.col("equity") > 0, F.col("n") / F.col("equity"))
    return r.select("account", "ts", gross.alias("gross"), net.alias("net"), F.coalesce((gross > max_gross) | (F.abs(net) > max_net), F.lit(False)).alias("breach"))


def open_positions(positions: DataFrame) -> DataFrame:
    """The last position of each account and symbol that isn't flat."""
    last = positions.groupBy("account", "symbol").agg(F.max_by(F.struct("position", "fill_px"), F.struct("ts", "seq")).alias("s"))
    return last.select("account", "symbol", "s.*").filter("position <> 0")


def closing_fills(positions: DataFrame, ts: str) -> DataFrame:
    """Fills at ts that would close every open position at its last fill price."""
    p = F.col("position")
    side = F.when(p > 0, "sell").otherwise("buy")
    return open_positions(positions).select("account", "symbol", F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit((1 << 62)).alias("seq"), side.alias("side"), F.abs(p).alias("qty"), F.col("fill_px").alias("price"), F.lit(1.0).alias("leverage"))


def trade_log(ledger: DataFrame, payments: DataFrame) -> DataFrame:
    """Fills and funding payments in one table, with nulls where a column doesn't apply."""
    trades = ledger.select("account", "symbol", "ts", F.when(F.col("action").isin("close", "reduce"), "close").otherwise("open").alias("type"), "side", "qty", "fill_px", "fee")
    return trades.unionByName(payments.select("account", "symbol", "ts", F.lit("funding").alias("type"), "payment"), allowMissingColumns=True)
