"""Column functions on symbols, times, prices and returns. Missing values are null, never NaN or infinity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of each unit that a timeframe may name.
UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def normalize_symbol(symbol: Column) -> Column:
    return F.upper(F.replace(symbol, F.lit("/"), F.lit("")))


def timeframe_ms(timeframe: str) -> int:
    """Milliseconds of a timeframe such as 5m, 8h, 1d or 2w; anything else is an error."""
    m = re.fullmatch(r"(\d+)([mhdw])", timeframe.strip())
    if not m or int(m[1]) < 1:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(m[1]) * UNIT_MS[m[2]]


def timeframe_ms_col(timeframe: Column) -> Column:
    n, unit = F.regexp_extract(timeframe, r"^(\d+)([mhdw])$", 1), F.regexp_extract(timeframe, r"^(\d+)([mhdw])$", 2)
    size = F.coalesce(*[F.when(unit == u, F.lit(ms).cast("long")) for u, ms in UNIT_MS.items()])
    return F.when(size.isNull(), F.raise_error(F.concat(F.lit("unknown timeframe "), timeframe)).cast("long")).otherwise(n.try_cast("long") * size)


def bars_per_day(timeframe: str) -> int:
    return max(1, UNIT_MS["d"] // timeframe_ms(timeframe))


def unix_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def align_ms(ms: Column, tf_ms: int) -> Column:
    return (F.floor(ms / tf_ms) * tf_ms).cast("long")


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def align(ts: Column, timeframe: str) -> Column:
    """Start of the grid step that holds ts, counted from the epoch."""
    return from_millis(align_ms(unix_millis(ts), timeframe_ms(timeframe)))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def log_return(close: Column, previous: Column) -> Column:
    return F.when((close > 0) & (previous > 0), F.ln(close) - F.ln(previous))


def simple_return(close: Column, previous: Column) -> Column:
    return F.when(previous > 0, F.try_divide(close - previous, previous))


def to_simple(log_ret: Column) -> Column:
    return F.exp(log_ret) - 1


def candle_change_pct(open_: Column, close: Column) -> Column:
    return F.coalesce(F.try_divide(close - open_, open_) * 100, F.lit(0.0))


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def floor_to_step(quantity: Column, step: Column) -> Column:
    return F.when(step > 0, F.floor(F.try_divide(quantity + 1e-12, step)) * step).otherwise(quantity)


def slipped_price(price: Column, side: Column, bps: Column) -> Column:
    return price * (1 + bps / 1e4 * F.when(F.lower(side) == "buy", 1).otherwise(-1))


def fee(notional: Column, rate) -> Column:
    return F.abs(notional) * rate


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)
