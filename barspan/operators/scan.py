"""Linear recurrences s = a * s(previous) + b over ordered rows, without a loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_size(decay: float) -> int:
    """Rows of a block after which less than 1e-13 of a term is left, as a power of two from 16 on."""
    return 1 << max(4, math.ceil(math.log2(-30 / math.log(decay)))) if 0 < decay < 1 else 16


def affine_scan(df: DataFrame, b: str, decay: float, out: str, by: str | list[str] = "symbol", order: str = "bar_ts") -> DataFrame:
    """Add `out`, the recurrence over rows whose b isn't null; rows with null b get null and don't count.

    Rows are numbered within their key and cut into blocks. Sums of scaled terms give the recurrence inside a block; what
    two blocks before hand over completes it, older terms being below 1e-13 of themselves. All of it is windows of one key
    and order, so that a chain of scans and other windows shares one exchange by the key and reads its source once.
    """
    k, keys = block_size(decay), [by] if isinstance(by, str) else by
    w = Window.partitionBy(*keys).orderBy(order)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = F.lit(float(decay))
    rows = df.withColumn("_n", F.count(b).over(w) - 1).withColumn("_block", F.floor(F.col("_n") / k)).withColumn("_j", F.col("_n") % k)
    local = F.pow(d, F.col("_j")) * F.sum(F.col(b) * F.pow(d, -F.col("_j"))).over(inside)
    rows = rows.withColumn("_local", F.when(F.col(b).isNotNull(), local))
    is_end = F.col(b).isNotNull() & (F.col("_j") == k - 1)
    rows = rows.withColumn("_end", F.last(F.when(is_end, F.col("_local")), ignorenulls=True).over(before))
    rows = rows.withColumn("_end2", F.last(F.when(is_end, F.col("_end")), ignorenulls=True).over(before))
    carry = F.coalesce("_end", F.lit(0.0)) + F.pow(d, F.lit(k)) * F.coalesce("_end2", F.lit(0.0))
    return rows.withColumn(out, F.col("_local") + F.pow(d, F.col("_j") + 1) * carry).drop("_n", "_block", "_j", "_local", "_end", "_end2")


def ema(df: DataFrame, x: str, span: int, out: str, by: str = "symbol", order: str = "bar_ts") -> DataFrame:
    """Exponential average with weight 2 / (span + 1), started by the first value."""
    a = 2 / (span + 1)
    first = F.count(x).over(Window.partitionBy(by).orderBy(order)) == 1
    b = F.when(F.col(x).isNotNull(), F.when(first, F.col(x)).otherwise(F.col(x) * a))
    return affine_scan(df.withColumn("_b", b), "_b", 1 - a, out, by, order).drop("_b")


def wilder(df: DataFrame, x: str, n: int, out: str, by: str = "symbol", order: str = "bar_ts") -> DataFrame:
    """Wilder's smoothing: the mean of the first n values, then moved by 1/n of the difference at each."""
    w = Window.partitionBy(by).orderBy(order)
    at = F.count(x).over(w)
    seed = F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.when(F.col(x).isNotNull() & (at == n), seed).when(F.col(x).isNotNull() & (at > n), F.col(x) / n)
    return affine_scan(df.withColumn("_b", b), "_b", 1 - 1 / n, out, by, order).drop("_b")


def seeded(x: Column, at: Column, n: int, seed: Column, later: Column) -> Column:
    """Terms of a recurrence that starts with seed at the n-th value and goes on with later."""
    return F.when(x.isNotNull() & (at == n), seed).when(x.isNotNull() & (at > n), later)


#: Natural logarithm of what is left of a value after a block: below all digits of a double.
_SPAN = 200.0


def varying_scan(df: DataFrame, a: Column, b: Column, out: str, by: list[str], order: list[str]) -> DataFrame:
    """Add `out`, the recurrence s = a * s(previous) + b with a coefficient of its own for each row, 0 <= a <= 1; null ones count as 1, null b as 0.

    A row with a = 0 starts a run. It is cut where the sum of the coefficients' logarithms has fallen by another 200: inside a
    block sums of terms over running products give the recurrence without leaving the range of doubles, and of what
    came before only the block before counts, as the rest has shrunk to e^-200 of itself. Runs and blocks are windows within
    the key, so that all of it shares the key's exchange with the windows around it.
    """
    rows = df.withColumn("_a", F.coalesce(a, F.lit(1.0))).withColumn("_b", F.coalesce(b, F.lit(0.0)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_a") == 0, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order)))
    rows = rows.withColumn("_log", F.when(F.col("_a") > 0, F.ln("_a")).otherwise(0.0))
    run = Window.partitionBy(*by, "_run").orderBy(*order)
    rows = rows.withColumn("_block", F.floor(-F.sum("_log").over(run.rowsBetween(Window.unboundedPreceding, 0)) / _SPAN))
    block = Window.partitionBy(*by, "_run", "_block").orderBy(*order)
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    # The first row's own coefficient stands between the blocks, however small it is; those behind it stay within the span.
    rows = rows.withColumn("_first", F.row_number().over(block) == 1)
    rows = rows.withColumn("_step", F.first("_a").over(upto)).withColumn("_in", F.product(F.when(F.col("_first"), 1.0).otherwise(F.col("_a"))).over(upto))
    rows = rows.withColumn("_local", F.col("_in") * F.sum(F.col("_b") / F.col("_in")).over(upto))
    rows = rows.withColumn("_before", F.lag("_local").over(run))
    carry = F.coalesce(F.first("_before").over(upto), F.lit(0.0))
    made = rows.withColumn(out, F.col("_local") + F.col("_in") * F.col("_step") * carry)
    return made.drop("_a", "_b", "_run", "_log", "_block", "_first", "_step", "_in", "_local", "_before")
