"""Stateful operators on bars: gaps with timers, bars in order, funding for the next bar."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from barspan.functions.scalars import timeframe_ms


def _times(rows: Iterator[pd.DataFrame]) -> list[int]:
    return sorted({int(t) for pdf in rows for t in pdf["ms"]})


class _Keyed(StatefulProcessor):
    """State of one symbol: the time of its last bar and a timer, which must be the only one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, silent long")

    def close(self) -> None:
        pass

    def wake_at(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)


class GapState(_Keyed):
    """Reports grid steps without a bar: as the next bar comes, or as the watermark passes them."""

    def __init__(self, step: int, expire_after: int):
        self.step, self.expire_after = step, expire_after

    def _told(self, key, steps: list[int]) -> Iterator[pd.DataFrame]:
        if steps:
            yield pd.DataFrame({"symbol": [key[0]] * len(steps), "ms": steps})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out: list[int] = []
        for t in _times(rows):
            if last is not None and t <= last:
                continue
            if last is not None:
                out += range(last + self.step, t, self.step)
            last = t
        self.last.update((last, 0))
        self.wake_at(last + self.step)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.last.get()
        known = timerValues.getCurrentWatermarkInMs()
        due = min((known - last) // self.step, self.expire_after - silent)
        out = [last + self.step * (i + 1) for i in range(due)]
        if silent + due >= self.expire_after:
            self.last.clear()
        else:
            self.last.update((last + self.step * due, silent + due))
            self.handle.registerTimer(last + self.step * (due + 1))
        yield from self._told(key, out)


def gaps(bars: DataFrame, timeframe: str, delay: str = "1 hour", expire_after: int = 24) -> DataFrame:
    """(symbol, bar_ts) of grid steps without a bar, each once.

    A step is reported when a later bar of its symbol comes, or when the watermark (the newest time of any symbol less the
    delay) passes it. A symbol that is silent for `expire_after` steps is forgotten, and starts anew with its next bar. Bars
    at or before what is known of their symbol are dropped.
    """
    keyed = bars.withWatermark("event_ts", delay).select("symbol", "event_ts", F.unix_millis("event_ts").alias("ms")).groupBy("symbol")
    found = keyed.transformWithStateInPandas(GapState(timeframe_ms(timeframe), expire_after), "symbol string, ms long", "Append", "EventTime")
    return found.select("symbol", F.timestamp_millis("ms").alias("bar_ts"))


class OrderState(_Keyed):
    """Lets through what is later than all before; forgets a symbol once the watermark itself keeps older bars out."""

    def __init__(self, names: list[str], with_previous: bool):
        self.names, self.with_previous = names, with_previous

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values("ms", kind="stable").drop_duplicates("ms")
        batch = batch if last is None else batch[batch["ms"] > last]
        if len(batch):
            self.last.update((int(batch["ms"].iloc[-1]), 0))
            if not self.with_previous:
                self.wake_at(int(batch["ms"].iloc[-1]) + 1)
        if self.with_previous:
            before = batch["ms"].shift(1).astype("Int64")
            if len(batch):
                before.iloc[0] = pd.NA if last is None else last
            batch = batch.assign(prev_ms=before)
        if len(batch):
            yield batch[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


class ContinueState(OrderState):
    """As OrderState, from the times of a history on, and without end."""

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["last_ms"].max()), 0))

    def wake_at(self, ms: int) -> None:
        pass


def _ordered(bars: DataFrame, delay: str, with_previous: bool) -> DataFrame:
    rows = bars.withWatermark("event_ts", delay).withColumn("ms", F.unix_millis("event_ts"))
    schema = StructType([rows.schema[c] for c in rows.columns])
    schema = schema.add("prev_ms", "long") if with_previous else schema
    processor = OrderState(schema.names, with_previous)
    return rows.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "EventTime", None, "event_ts")


def in_order(bars: DataFrame, delay: str = "365 days") -> DataFrame:
    """Bars that are later than all bars of their symbol in earlier batches; within a batch they are taken in order of time.

    This is the strict way with late bars. The tolerant one is a watermark with a delay, as in tick_bars. State is one time
    for each symbol, and goes once the watermark has passed it.
    """
    return _ordered(bars, delay, False).drop("ms")


def after_history(bars: DataFrame, history: DataFrame) -> DataFrame:
    """Bars of a stream that are later than all of their symbol, in the history (symbol, bar_ts) and on the stream.

    State starts with each symbol's last time in the history, so that bars which both hold come once. It stays, one time for a
    symbol, since a source may send its past again at any time.
    """
    rows = bars.withColumn("ms", F.unix_millis("event_ts"))
    schema = StructType([rows.schema[c] for c in rows.columns])
    last = history.groupBy("symbol").agg(F.unix_millis(F.max("bar_ts").cast("timestamp")).alias("last_ms")).groupBy("symbol")
    made = rows.groupBy("symbol").transformWithStateInPandas(ContinueState(schema.names, False), schema, "Append", "None", last)
    return made.drop("ms")


def next_funding(bars: DataFrame, funding: DataFrame, delay: str = "1 hour", within: str = "7 days") -> DataFrame:
    """Bars with the newest funding rate that came after the bar before and up to their own time; 0 where there is none.

    bars and funding (symbol, funding_ts, rate) are streams. Each rate goes to one bar: the first of its symbol at or after its
    time, no more than `within` later; of several rates for one bar the newest counts. Both sides have watermarks, so that
    a bar comes out once no rate for it can come any more, and rows that nothing can match any more leave the state. The time
    of the bar before comes from a state of one number for each symbol.
    """
    later = _ordered(bars, delay, True)
    rates = funding.select(F.col("symbol").alias("of"), "funding_ts", "rate").withWatermark("funding_ts", delay)
    since = F.coalesce(F.timestamp_millis("prev_ms"), F.lit("1900-01-01").cast("timestamp"))
    near = F.expr(f"funding_ts <= event_ts AND funding_ts >= event_ts - INTERVAL {within}")
    joined = later.join(rates, (F.col("symbol") == F.col("of")) & near & (F.col("funding_ts") > since), "leftOuter")
    names = [c for c in bars.columns if c not in ("symbol", "event_ts")]
    newest = joined.groupBy("symbol", "event_ts", *names).agg(F.max_by("rate", "funding_ts").alias("funding"))
    return newest.select("symbol", "event_ts", *names, F.coalesce("funding", F.lit(0.0)).alias("funding"))


class MomentumState(_Keyed):
    def __init__(self, weight: float):
        self.weight = weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, close double, r1 double, r2 double, avg double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, close, r1, r2, avg = self.last.get() if self.last.exists() else (None, None, None, None, None)
        out = []
        for t, c in sorted({(int(t), float(c)) for pdf in rows for t, c in zip(pdf["ms"], pdf["close"], strict=True)}):
            if last is not None and t <= last:
                continue
            r = math.log(c) - math.log(close) if close is not None and c > 0 and close > 0 else None
            three = [x for x in (r2, r1, r) if x is not None]
            root = math.sqrt(sum(x * x for x in three))
            avg = c if avg is None else self.weight * c + (1 - self.weight) * avg
            out.append((key[0], t, r, sum(three) / (root or 1e-9) if three else None, avg))
            last, close, r1, r2 = t, c, r, r1
        if last is not None:
            self.last.update((last, close, r1, r2, avg))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ms", "log_ret", "mom_3", "ema"]).astype({c: float for c in ("log_ret", "mom_3", "ema")})


def live_momentum(bars: DataFrame, spans: int = 20) -> DataFrame:
    """(symbol, bar_ts, log_ret, mom_3, ema) of each new bar from five numbers of state; late bars are dropped."""
    keyed = bars.select("symbol", F.unix_millis("event_ts").alias("ms"), "close").groupBy("symbol")
    made = keyed.transformWithStateInPandas(MomentumState(2 / (spans + 1)), "symbol string, ms long, log_ret double, mom_3 double, ema double", "Append", "None")
    return made.select("symbol", F.timestamp_millis("ms").alias("bar_ts"), "log_ret", "mom_3", "ema")
