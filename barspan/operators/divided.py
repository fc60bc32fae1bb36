"""Recurrences and rolling windows that divide a symbol: chunks of it are tasks, with summaries of chunks carried in between.

The functions of features and risk keep a symbol in one task. These give the same values where one symbol holds so many
bars that this is too slow: a first pass sums up each chunk, a scan over these summaries (one row a chunk) carries them on, and
a second pass adds to each chunk what came before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import timeframe_ms
from barspan.operators.scan import affine_scan, varying_scan
from barspan.sources.scratch import scratch_path

KEY = ["symbol", "_chunk"]


def chunks(bars: DataFrame, span: str) -> DataFrame:
    """Add _chunk: the number of the span of time (a timeframe, as "30d") that a bar lies in, so that one holds a bounded number of bars of a grid."""
    return bars.withColumn("_chunk", F.floor(F.unix_millis(F.col("bar_ts").cast("timestamp")) / timeframe_ms(span)))


def inside():
    return Window.partitionBy(*KEY).orderBy("bar_ts")


def over_chunks():
    return Window.partitionBy("symbol").orderBy("_chunk")


def cut(rows: DataFrame, label: str) -> DataFrame:
    """rows written and read back, so that passes after it don't repeat those before."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lagged(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add for each (out: column) the value of the bar before, and bar_no, the bar's number within its symbol."""
    ends = rows.groupBy(*KEY).agg(F.count("*").alias("_rows"), *[F.max_by(c, "bar_ts").alias(f"_end_{out}") for out, c in columns.items()])
    before = ends.select(*KEY, F.sum("_rows").over(over_chunks().rowsBetween(Window.unboundedPreceding, -1)).alias("_rows"), *[F.lag(f"_end_{o}").over(over_chunks()).alias(f"_end_{o}") for o in columns])
    first = F.row_number().over(inside()) == 1
    made = rows.join(before, KEY).withColumn("bar_no", F.row_number().over(inside()) + F.coalesce("_rows", F.lit(0)))
    for out, c in columns.items():
        made = made.withColumn(out, F.when(first, F.col(f"_end_{out}")).otherwise(F.lag(c).over(inside())))
    return made.drop("_rows", *[f"_end_{o}" for o in columns])


@dataclass
class Recurrence:
    """s = decay * s(previous) + term from the n-th value on, where s is `seed` over the first n values; none before."""

    x: str
    term: Column
    decay: float
    n: int
    seed: object = F.avg


def ema_of(x: str, span: int) -> Recurrence:
    return Recurrence(x, F.col(x) * (2 / (span + 1)), 1 - 2 / (span + 1), 1)


def wilder_of(x: str, n: int) -> Recurrence:
    return Recurrence(x, F.col(x) / n, 1 - 1 / n, n)


def from_nothing(rows: DataFrame, wanted: dict[str, Recurrence]) -> DataFrame:
    """Add for each recurrence `<out>_g`, the same recurrence from 0 over all values, and `<out>_k`, the number of values so far."""
    local, ends = rows, []
    for out, r in wanted.items():
        valid = F.col(r.x).isNotNull()
        local = affine_scan(local.withColumn("_b", F.when(valid, r.term)), "_b", r.decay, f"{out}_g", KEY).drop("_b").withColumn(f"{out}_k", F.count(r.x).over(inside()))
        ends += [F.max(f"{out}_k").alias(f"_k_{out}"), F.coalesce(F.max_by(f"{out}_g", F.when(valid, F.col(f"{out}_k"))), F.lit(0.0)).alias(f"_g_{out}")]
    states = local.groupBy(*KEY).agg(*ends)
    for out, r in wanted.items():
        states = varying_scan(states, F.pow(F.lit(r.decay), F.col(f"_k_{out}")), F.col(f"_g_{out}"), f"_s_{out}", ["symbol"], ["_chunk"])
    earlier = over_chunks().rowsBetween(Window.unboundedPreceding, -1)
    before = states.select(*KEY, *[F.coalesce(F.lag(f"_s_{o}").over(over_chunks()), F.lit(0.0)).alias(f"_s_{o}") for o in wanted], *[F.coalesce(F.sum(f"_k_{o}").over(earlier), F.lit(0)).alias(f"_k_{o}") for o in wanted])
    made = local.join(before, KEY)
    for out, r in wanted.items():
        carried = F.pow(F.lit(r.decay), F.col(f"{out}_k")) * F.col(f"_s_{out}")
        made = made.withColumn(f"{out}_g", F.col(f"{out}_g") + carried).withColumn(f"{out}_k", F.col(f"{out}_k") + F.col(f"_k_{out}"))
    return made.drop(*[f"_{c}_{o}" for c in "sk" for o in wanted])


def recurrences(rows: DataFrame, wanted: dict[str, Recurrence], label: str) -> DataFrame:
    """Add each recurrence as a column. What starts it is a constant for a symbol: from the n-th value on the recurrence from
    nothing lacks decay^(k - n) times (seed - its own n-th value)."""
    made = cut(from_nothing(rows, wanted), label)
    starts = []
    for out, r in wanted.items():
        early = F.col(r.x).isNotNull() & (F.col(f"{out}_k") <= r.n)
        starts += [r.seed(F.when(early, F.col(r.x))).alias(f"_seed_{out}"), F.max(F.when(early & (F.col(f"{out}_k") == r.n), F.col(f"{out}_g"))).alias(f"_at_{out}")]
    some = " or ".join(f"{out}_k <= {r.n}" for out, r in wanted.items())
    # One row a symbol, put beside its chunks, so that rows meet it by chunk.
    by_chunk = made.select(*KEY).distinct().join(made.filter(some).groupBy("symbol").agg(*starts), "symbol")
    made = made.join(by_chunk, KEY)
    for out, r in wanted.items():
        lacking = F.pow(F.lit(r.decay), F.col(f"{out}_k") - r.n) * (F.col(f"_seed_{out}") - F.col(f"_at_{out}"))
        made = made.withColumn(out, F.when(F.col(r.x).isNotNull() & (F.col(f"{out}_k") >= r.n), F.col(f"{out}_g") + lacking))
    return made.drop(*[f"_{c}_{o}" for c in ("seed", "at") for o in wanted], *[f"{o}_{c}" for o in wanted for c in "gk"])


def numbered_parts(rows: DataFrame, number: str, size: int, overlap: int) -> DataFrame:
    """rows by parts of `size` consecutive numbers, each with the `overlap` rows before it as well: add _part and _own (false for those).

    A window of up to overlap + 1 rows within (symbol, _part) then sees for its own rows what it would see in the whole symbol.
    """
    if size < overlap:
        raise ValueError("parts must be as long as what they overlap")
    part = F.floor(F.col(number) / size)
    both = F.when(F.col(number) % size >= size - overlap, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_next", F.explode(both)).withColumn("_part", part + F.col("_next")).withColumn("_own", F.col("_next") == 0).drop("_next")


def rsi_innovation(bars: DataFrame, span: str, n: int = 12, ema_span: int = 20, out: str = "rsi_innov") -> DataFrame:
    """As with_rsi_innovation, of bars in chunks of `span`."""
    rows = lagged(chunks(bars, span), {"_prev": "close"})
    diff = F.col("close") - F.col("_prev")
    rows = rows.withColumns({"_up": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "_down": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0)))})
    rows = recurrences(rows, {"_au": wilder_of("_up", n), "_ad": wilder_of("_down", n)}, "rsi-averages")
    rs = F.try_divide(F.col("_au"), F.col("_ad"))
    rows = rows.withColumn("_rsi", F.when(F.col("_ad") > 1e-300, 100 - 100 / (1 + rs)).when(F.col("_au") > 0, 100.0).when(F.col("_au") == 0, 50.0))
    rows = recurrences(rows, {"_ema": ema_of("_rsi", ema_span)}, "rsi-ema")
    return rows.withColumn(out, F.when(F.col("bar_no") >= ema_span, F.col("_rsi") - F.col("_ema"))).select(*bars.columns, out)


def atr_innovation(bars: DataFrame, span: str, n: int = 14, ema_span: int = 20, out: str = "atr_innov") -> DataFrame:
    """As with_atr_innovation, of bars in chunks of `span`."""
    rows = lagged(chunks(bars, span), {"_prev": "close"})
    rows = rows.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))))
    rows = recurrences(rows, {"_atr": wilder_of("_tr", n)}, "atr-average").withColumn("_pct", F.try_divide("_atr", "close"))
    rows = recurrences(rows, {"_ema": ema_of("_pct", ema_span)}, "atr-ema")
    return rows.withColumn(out, F.when(F.col("bar_no") >= ema_span, F.col("_pct") - F.col("_ema"))).select(*bars.columns, out)


def ewma_variance(returns: DataFrame, span: str, decay: float = 0.94, window: int = 30, floor: float = 1e-10, out: str = "ewma_var") -> DataFrame:
    """As risk.ewma_variance, of returns in chunks of `span`."""
    wanted = {"_v": Recurrence("ret", (1 - decay) * F.col("ret") * F.col("ret"), decay, window, F.var_samp)}
    rows = recurrences(chunks(returns, span), wanted, "ewma-variance")
    return rows.withColumn(out, F.when(F.col("_v").isNotNull(), F.greatest(F.col("_v"), F.lit(floor)))).select(*returns.columns, out)


def garch_variance(returns: DataFrame, span: str, omega: float = 1e-6, alpha: float = 0.05, beta: float = 0.9, window: int = 60, size: int = 4096, out: str = "garch_var") -> DataFrame:
    """As risk.garch_variance, of returns in chunks of `span` and then in parts of `size` values that overlap by the window."""
    wanted = {"_s": Recurrence("ret", omega + alpha * F.col("ret") * F.col("ret"), beta, 1)}
    rows = cut(from_nothing(chunks(returns, span), wanted), "garch-scan")
    valid = rows.filter("ret is not null").select("symbol", "_chunk", "bar_ts", "ret", F.col("_s_g").alias("s"), F.col("_s_k").alias("k"))
    parts = Window.partitionBy("symbol", "_part").orderBy("k")
    gone, seed = F.lag("s", window).over(parts), F.var_samp("ret").over(parts.rowsBetween(-(window - 1), 0))
    value = F.when(F.col("k") >= window, F.col("s") - beta**window * F.coalesce(gone, F.lit(0.0)) + beta**window * seed)
    made = numbered_parts(valid, "k", max(size, window), window).withColumn(out, value).filter("_own").select("symbol", "_chunk", "bar_ts", out)
    return rows.join(made, [*KEY, "bar_ts"], "left").select(*returns.columns, out)
