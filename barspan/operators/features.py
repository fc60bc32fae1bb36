"""Technical features over bars, expanding winsorised z-scores, lookback windows and supervised sequences."""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.operators.grid import by_symbol
from barspan.operators.returns import with_returns
from barspan.operators.scan import ema, wilder
from barspan.schema import FEATURES


def tsmom(log_ret: str, k: int) -> Column:
    """Sum of the last k log returns over the root of the sum of their squares, fewer at the start."""
    w = by_symbol().rowsBetween(-(k - 1), 0)
    root = F.sqrt(F.sum(F.pow(log_ret, F.lit(2.0))).over(w))
    return F.sum(log_ret).over(w) / F.when(root == 0, 1e-9).otherwise(root)


def smoothed_moves(bars: DataFrame, n: int) -> DataFrame:
    """Add rises and falls of the close (_up, _down), their averages (_au, _ad) and Wilder's RSI (_rsi)."""
    diff = F.col("close") - F.lag("close").over(by_symbol())
    moved = bars.withColumns({"_up": F.greatest(diff, F.lit(0.0)), "_down": F.greatest(-diff, F.lit(0.0))}).withColumns({"_up": F.when(diff.isNotNull(), F.col("_up")), "_down": F.when(diff.isNotNull(), F.col("_down"))})
    smooth = wilder(wilder(moved, "_up", n, "_au"), "_down", n, "_ad")
    rs = F.try_divide(F.col("_au"), F.col("_ad"))
    return smooth.withColumn("_rsi", F.when(F.col("_ad") > 1e-300, 100 - 100 / (1 + rs)).when(F.col("_au") > 0, 100.0).when(F.col("_au") == 0, 50.0))


def with_rsi(bars: DataFrame, n: int = 12, out: str = "rsi") -> DataFrame:
    """Wilder's RSI: 100 where only rises are left, 50 where nothing moves, null for the first n bars."""
    rows = smoothed_moves(bars, n).drop("_up", "_down", "_au", "_ad")
    return rows.withColumnRenamed("_rsi", out)


def innovation(df: DataFrame, x: str, span: int, out: str) -> DataFrame:
    return ema(df, x, span, "_ema").withColumn(out, F.col(x) - F.col("_ema")).drop("_ema")


def with_rsi_innovation(bars: DataFrame, n: int = 12, span: int = 20, out: str = "rsi_innov") -> DataFrame:
    """RSI less its exponential average; null while fewer than `span` bars are there."""
    rows = innovation(with_rsi(bars, n, "_rsi"), "_rsi", span, out).drop("_rsi")
    return rows.withColumn(out, F.when(F.row_number().over(by_symbol()) >= span, F.col(out)))


def true_range() -> Column:
    prev = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_atr_innovation(bars: DataFrame, n: int = 14, span: int = 20, out: str = "atr_innov") -> DataFrame:
    """Wilder's average true range over the close, less its exponential average; null before bar `span`."""
    rows = wilder(bars.withColumn("_tr", true_range()), "_tr", n, "_atr").withColumn("_pct", F.try_divide("_atr", "close"))
    rows = innovation(rows, "_pct", span, out).drop("_tr", "_atr", "_pct")
    return rows.withColumn(out, F.when(F.row_number().over(by_symbol()) >= span, F.col(out)))


def obv_tilt(window: int = 60) -> Column:
    """Signed volume over the mean dollar volume of the last bars; null on a symbol's first bar, 0 where the mean is 0."""
    prev = F.lag("close").over(by_symbol())
    mean = F.avg(F.col("close") * F.col("volume")).over(by_symbol().rowsBetween(-(window - 1), 0))
    return F.when(prev.isNotNull(), F.coalesce(F.try_divide(F.signum(F.col("close") - prev) * F.col("volume"), mean), F.lit(0.0)))


def with_funding(bars: DataFrame, funding: DataFrame, out: str = "funding") -> DataFrame:
    """The funding rate of the bar's own time, 0 where there is none."""
    rates = funding.select("symbol", F.col("ts").alias("bar_ts"), F.col("rate").alias("_rate"))
    return bars.join(rates, ["symbol", "bar_ts"], "left").withColumn(out, F.coalesce("_rate", F.lit(0.0))).drop("_rate")


class _Pool:
    """Numbers of an index that one side, or both, can be taken from in order; what has left is skipped when it comes up."""

    def __init__(self, values: np.ndarray, home: np.ndarray, name: int, least: bool, most: bool):
        self.values, self.home, self.name = values, home, name
        self.up: list | None = [] if least else None
        self.down: list | None = [] if most else None
        self.size, self.total, self.square = 0, 0.0, 0.0

    def add(self, i: int) -> None:
        v = float(self.values[i])
        self.home[i] = self.name
        self.size, self.total, self.square = self.size + 1, self.total + v, self.square + v * v
        if self.up is not None:
            heappush(self.up, (v, i))
        if self.down is not None:
            heappush(self.down, (-v, i))

    def _end(self, heap: list) -> tuple:
        while self.home[heap[0][1]] != self.name:
            heappop(heap)
        return heap[0]

    def least(self) -> float:
        return self._end(self.up)[0]

    def most(self) -> float:
        return -self._end(self.down)[0]

    def take(self, most: bool) -> int:
        heap = self.down if most else self.up
        i = self._end(heap)[1]
        heappop(heap)
        v = float(self.values[i])
        self.home[i] = 0
        self.size, self.total, self.square = self.size - 1, self.total - v, self.square - v * v
        return i


def winsor_z_values(x: np.ndarray, warmup: int = 200, lo: float = 0.01, hi: float = 0.99) -> np.ndarray:
    """Expanding winsorised z-scores of one ordered series; missing values neither count nor score.

    The history is kept as what lies below the lower percentile, between and above, each in heaps, so that a value costs
    the logarithm of their number; sums of the middle give the clipped moments, as the ends all count as a percentile.
    """
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(np.isfinite(x))
    if len(at) < max(warmup, 1):
        return out
    shift = float(x[at[0]])  # moments are taken about it, so that a level far from 0 costs no digits
    v = x[at] - shift
    home = np.zeros(len(v), np.int8)
    low, middle, high = _Pool(v, home, 1, False, True), _Pool(v, home, 2, True, True), _Pool(v, home, 3, True, False)
    for i in range(len(v)):
        n = i + 1
        (low if low.size and v[i] < low.most() else high if high.size and v[i] > high.least() else middle).add(i)
        p, q = lo * (n - 1), hi * (n - 1)
        n_low, n_high = int(p) + 1, n - 1 - int(q)
        while low.size > n_low:
            middle.add(low.take(True))
        while high.size > n_high:
            middle.add(high.take(False))
        while low.size < n_low and middle.size:
            low.add(middle.take(False))
        while high.size < n_high and middle.size:
            high.add(middle.take(True))
        if n & (n - 1) == 0:  # sums anew, before rounding errors of what came and went can add up
            held = v[:n][home[:n] == 2]
            middle.total, middle.square = math.fsum(held), math.fsum(held * held)
        if n < warmup:
            continue
        if n < 4:
            cuts = np.quantile(v[:n], [lo, hi])
            clipped = np.clip(v[:n], *cuts)
            mean, sd = clipped.mean(), clipped.std()
        else:
            below, above = low.most(), high.least()
            cuts = below + (p - int(p)) * (middle.least() - below), middle.most() + (q - int(q)) * (above - middle.most())
            mean = (low.size * cuts[0] + middle.total + high.size * cuts[1]) / n
            second = (low.size * cuts[0] ** 2 + middle.square + high.size * cuts[1] ** 2) / n
            sd = math.sqrt(max(0.0, second - mean * mean)) if cuts[1] > cuts[0] else 0.0
        out[at[i]] = (min(max(v[i], cuts[0]), cuts[1]) - mean) / (sd if sd > 0 else 1.0)
    return out


def _scored(rows: DataFrame, columns: list[str], warmup: int, raw: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, bar_ts, column...): z-scores of the columns, those in raw as they are; symbols times columns run in parallel."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_ts")
        x = pdf["x"].to_numpy(dtype=float, na_value=np.nan)
        return pdf.assign(z=x if pdf["feature"].iloc[0] in raw else winsor_z_values(x, warmup))[["symbol", "bar_ts", "feature", "z"]]

    long = rows.unpivot(["symbol", "bar_ts"], columns, "feature", "x")
    scored = long.groupBy("symbol", "feature").applyInPandas(one, "symbol string, bar_ts timestamp_ntz, feature string, z double")
    wide = scored.groupBy("symbol", "bar_ts").pivot("feature", columns).agg(F.first("z"))
    return wide.select("symbol", "bar_ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def winsor_z(df: DataFrame, columns: list[str], warmup: int = 200) -> DataFrame:
    """Add <column>_z for each column."""
    z = _scored(df, columns, warmup)
    return df.join(z.withColumnsRenamed({c: f"{c}_z" for c in columns}), ["symbol", "bar_ts"], "left")


def winsor_z_native(x: str, warmup: int = 200) -> Column:
    """The same score from window functions alone: exact, but quadratic in the length of a series."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.percentile(x, 0.01).over(w), F.percentile(x, 0.99).over(w)
    clipped = F.transform(F.collect_list(x).over(w), lambda v: F.greatest(lo, F.least(hi, v)))
    mean = F.aggregate(clipped, F.lit(0.0), lambda a, v: a + v) / F.size(clipped)
    var = F.aggregate(clipped, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(clipped)
    score = (F.greatest(lo, F.least(hi, F.col(x))) - mean) / F.when(var > 0, F.sqrt(var)).otherwise(1.0)
    return F.when(F.col(x).isNotNull() & (F.count(x).over(w) >= warmup), score)


def raw_features(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """The eight features before scaling, in the order of the schema."""
    rows = with_returns(bars)
    rows = rows.withColumns({"mom_3": tsmom("log_ret", 3), "mom_15": tsmom("log_ret", 15), "obv_tilt": obv_tilt(), "log_volume": F.log1p("volume"), "log_return": F.col("log_ret")})
    rows = with_funding(with_atr_innovation(with_rsi_innovation(rows)), funding)
    return rows.select("symbol", "bar_ts", *FEATURES)


def feature_frame(bars: DataFrame, funding: DataFrame, warmup: int = 200, raw=("log_return", "log_volume")) -> DataFrame:
    """The eight features with z-scores in place of all but log_return and log_volume."""
    return _scored(raw_features(bars, funding), list(FEATURES), warmup, tuple(raw)).select("symbol", "bar_ts", *FEATURES)


def feature_windows(features: DataFrame, length: int, columns=FEATURES) -> DataFrame:
    """(symbol, bar_ts, x): the last `length` feature rows, only where all of them are complete."""
    row = F.array(*columns)
    complete = F.forall(row, lambda v: v.isNotNull())
    w = by_symbol().rowsBetween(-(length - 1), 0)
    rows = features.select("symbol", "bar_ts", F.collect_list(F.when(complete, row)).over(w).alias("x"))
    return rows.filter(F.size("x") == length)


def supervised_sequences(features: DataFrame, length: int, columns=FEATURES, target: str = "log_return") -> DataFrame:
    """(symbol, target_ts, x, y): the `length` complete rows before each complete row, and that row's target."""
    rows = features.dropna(subset=list(columns))
    made = rows.select("symbol", F.col("bar_ts").alias("target_ts"), F.collect_list(F.array(*columns)).over(by_symbol().rowsBetween(-length, -1)).alias("x"), F.col(target).alias("y"))
    return made.filter(F.size("x") == length)


def feature_stats(sequences: DataFrame, columns=FEATURES) -> DataFrame:
    """Mean, deviation, least and greatest value of each feature over all steps of all sequences."""
    steps = sequences.select("symbol", F.explode("x").alias("row")).select("symbol", F.posexplode("row").alias("pos", "v"))
    named = steps.withColumn("feature", F.element_at(F.array(*map(F.lit, columns)), F.col("pos") + 1))
    s = named.groupBy("symbol", "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return s.withColumn("constant", F.col("std") == 0)
