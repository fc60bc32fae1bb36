"""All eight features of each new bar from state: values, windows and order statistics, seeded from batch tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barspan.operators import features as E
from barspan.operators.grid import last_n
from barspan.operators.order_stats import SortedBlocks, winsor_z_next
from barspan.operators.returns import with_returns
from barspan.operators.scan import ema, wilder
from barspan.schema import FEATURES
from barspan.sources.scratch import stored
from barspan.streaming.state import has_batches, rocksdb_state

RAW = ("log_return", "log_volume")
SCALED = tuple(c for c in FEATURES if c not in RAW)
RSI, ATR, SPAN, MOMENTA, TURNOVER = 12, 14, 20, (3, 15), 60

#: Of each symbol: the last bar, bars so far, and what the recurrences need. Up and down are sums before their averages start.
_NOW = "last_ms long, bars long, close double, moves long, up double, down double, rsi_n long, rsi_ema double, ranges long, atr double, atr_n long, atr_ema double"
_FRESH = (None, 0, None, 0, 0.0, 0.0, 0, None, 0, 0.0, 0, None)
_NAMES = [f.split()[0] for f in _NOW.split(", ")]
_SEED = "symbol string, feature string, block long, shift double, values array<double>, returns array<double>, turnover array<double>, " + _NOW
_OUT = "symbol string, ms long, " + ", ".join(f"{c} double" for c in FEATURES)


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


class FeatureState(StatefulProcessor):
    """One symbol's features. State: a row of numbers, the last returns and dollar volumes, and for each scaled feature the
    sorted blocks of its history. A bar reads and writes a handful of them, whatever the history's length."""

    def __init__(self, warmup: int = 200):
        self.warmup = warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", _NOW)
        self.returns = handle.getListState("returns", "value double")
        self.turnover = handle.getListState("turnover", "value double")
        self.blocks = handle.getMapState("blocks", "feature string, block long", "x binary")
        self.index = handle.getMapState("index", "feature string", "shift double, x binary")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of feature_state for the symbol, in any order and any number of calls."""
        for r in initialState.to_dict("records"):
            if r["feature"] is None:
                whole = ("last_ms", "bars", "moves", "rsi_n", "ranges", "atr_n")
                self.now.update(tuple(int(r[c]) if c in whole else _number(r[c]) for c in _NAMES))
                self.returns.put([(_number(v),) for v in r["returns"]])
                self.turnover.put([(_number(v),) for v in r["turnover"]])
                continue
            values, feature = np.asarray(r["values"], float), r["feature"]
            self.blocks.updateValue((feature, int(r["block"])), (values.tobytes(),))
            history = self._history(feature)
            index = np.vstack([history.index, [SortedBlocks.entry(int(r["block"]), values)]])
            self.index.updateValue((feature,), (float(r["shift"]), index[np.argsort(index[:, 1], kind="stable")].tobytes()))

    def _history(self, feature: str) -> SortedBlocks:
        load = lambda number: np.frombuffer(self.blocks.getValue((feature, number))[0])
        if not self.index.containsKey((feature,)):
            made = SortedBlocks(load)
            made.shift = None
            return made
        shift, index = self.index.getValue((feature,))
        made = SortedBlocks(load, np.frombuffer(index).reshape(-1, 5).copy())
        made.shift = shift
        return made

    def _store(self, histories: dict[str, SortedBlocks]) -> None:
        for feature, h in histories.items():
            for number in h.changed:
                self.blocks.updateValue((feature, number), (h.held[number].tobytes(),))
            if h.changed:
                self.index.updateValue((feature,), (h.shift, h.index.tobytes()))
            h.changed.clear()
            h.held.clear()

    def _score(self, history: SortedBlocks, value: float | None) -> float | None:
        if value is None or not math.isfinite(value):
            return None
        if history.shift is None:
            history.shift = value
        return winsor_z_next(history, value, self.warmup, shift=history.shift)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip(_NAMES, self.now.get() if self.now.exists() else _FRESH, strict=True))
        returns = [v for (v,) in self.returns.get()] if self.returns.exists() else []
        turnover = [v for (v,) in self.turnover.get()] if self.turnover.exists() else []
        histories = {f: self._history(f) for f in SCALED}
        batch = pd.concat(list(rows)).sort_values("ms", kind="stable").drop_duplicates("ms")
        out, columns = [], ("ms", "high", "low", "close", "volume", "funding")
        for ms, *numbers in batch[list(columns)].itertuples(index=False, name=None):
            if now["last_ms"] is not None and ms <= now["last_ms"]:
                continue
            raw = next_features(now, returns, turnover, *map(_number, numbers))
            now["last_ms"] = int(ms)
            out.append((key[0], int(ms), *(raw[f] if f in RAW else self._score(histories[f], raw[f]) for f in FEATURES)))
            if sum(len(h.held) for h in histories.values()) > 4096:
                self._store(histories)
        if out:
            self._store(histories)
            self.now.update(tuple(now[c] for c in _NAMES))
            self.returns.put([(v,) for v in returns])
            self.turnover.put([(v,) for v in turnover])
            yield pd.DataFrame(out, columns=["symbol", "ms", *FEATURES]).astype({c: float for c in FEATURES})


def _averaged(now: dict, name: str, n: int, window: int, value: float) -> float | None:
    """Wilder's average as of the n-th value: none before the window is full, its mean then; sums until then."""
    if n < window:
        now[name] += value
        return None
    now[name] = (now[name] + value) / window if n == window else now[name] * (1 - 1 / window) + value / window
    return now[name]


def _innovation(now: dict, of: str, value: float | None) -> float | None:
    if value is None:
        return None
    n, a = now[f"{of}_n"] + 1, 2 / (SPAN + 1)
    now[f"{of}_n"] = n
    now[f"{of}_ema"] = value if n == 1 else now[f"{of}_ema"] * (1 - a) + value * a
    return value - now[f"{of}_ema"]


def next_features(now: dict, returns: list, turnover: list, high, low, close, volume, funding) -> dict[str, float | None]:
    """Raw features of the next bar; now, returns and turnover move on. The same values as raw_features gives."""
    first, prev = now["bars"] == 0, now["close"]
    log_return = math.log(close) - math.log(prev) if close is not None and prev is not None and close > 0 and prev > 0 else None
    returns.append(log_return)
    del returns[: -max(MOMENTA)]
    turnover.append(close * volume if close is not None and volume is not None else None)
    del turnover[:-TURNOVER]
    out = {"log_return": log_return, "log_volume": math.log1p(volume) if volume is not None and volume > -1 else None, "funding": funding or 0.0}
    for k in MOMENTA:
        window = [v for v in returns[-k:] if v is not None]
        out[f"mom_{k}"] = sum(window) / (math.sqrt(sum(v * v for v in window)) or 1e-9) if window else None

    rsi = None
    if close is not None and prev is not None:
        now["moves"] += 1
        up = _averaged(now, "up", now["moves"], RSI, max(close - prev, 0.0))
        down = _averaged(now, "down", now["moves"], RSI, max(prev - close, 0.0))
        if up is not None:
            rsi = 100 - 100 / (1 + up / down) if down > 1e-300 else 100.0 if up > 0 else 50.0
    seen = [abs(a - b) for a, b in ((high, prev), (low, prev)) if a is not None and b is not None]
    seen += [high - low] if high is not None and low is not None else []
    ratio = None
    if seen:
        now["ranges"] += 1
        atr = _averaged(now, "atr", now["ranges"], ATR, max(seen))
        ratio = atr / close if atr is not None and close else None
    now["bars"] += 1
    late = now["bars"] >= SPAN
    for name, value in (("rsi", _innovation(now, "rsi", rsi)), ("atr", _innovation(now, "atr", ratio))):
        out[f"{name}_innov"] = value if late else None
    mean = [v for v in turnover if v is not None]
    out["obv_tilt"] = None
    if not first and prev is not None:
        mean = sum(mean) / len(mean) if mean else None
        sign = None if close is None else (close > prev) - (close < prev)
        out["obv_tilt"] = sign * volume / mean if mean and sign is not None and volume is not None else 0.0
    now["close"] = close
    return out


def feature_state(history: DataFrame, funding: DataFrame) -> DataFrame:
    """The state after a history of bars, computed by windows and aggregates: a row of numbers and windows for each symbol, and
    one for each block of a feature's sorted values."""
    rows = E.smoothed_moves(with_returns(history), RSI)
    rows = ema(rows, "_rsi", SPAN, "_rsi_ema")
    rows = wilder(rows.withColumn("_tr", E.true_range()), "_tr", ATR, "_atr").withColumn("_pct", F.try_divide("_atr", "close"))
    rows = ema(rows, "_pct", SPAN, "_pct_ema")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_ts")))
    held = lambda n, window, values, average: F.when(F.count(n) < window, F.coalesce(F.sum(values), F.lit(0.0))).otherwise(last(average))
    numbers = rows.groupBy("symbol").agg(
        F.unix_millis(F.max("bar_ts").cast("timestamp")).alias("last_ms"), F.count("*").alias("bars"), F.max_by("close", "bar_ts").alias("close"),
        F.count("_up").alias("moves"), held("_up", RSI, "_up", "_au").alias("up"), held("_down", RSI, "_down", "_ad").alias("down"), F.count("_rsi").alias("rsi_n"), last("_rsi_ema").alias("rsi_ema"),
        F.count("_tr").alias("ranges"), held("_tr", ATR, "_tr", "_atr").alias("atr"), F.count("_pct").alias("atr_n"), last("_pct_ema").alias("atr_ema"),
    )
    newest = F.sort_array(F.collect_list(F.struct("bar_ts", "log_ret", (F.col("close") * F.col("volume")).alias("dollars"))))
    windows = last_n(rows, TURNOVER).groupBy("symbol").agg(newest.alias("w"))
    windows = windows.select("symbol", F.slice(F.transform("w", lambda x: x["log_ret"]), -F.least(F.size("w"), F.lit(max(MOMENTA))), max(MOMENTA)).alias("returns"), F.transform("w", lambda x: x["dollars"]).alias("turnover"))
    long = E.raw_features(history, funding).unpivot(["symbol", "bar_ts"], list(SCALED), "feature", "x").filter("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    by_value = Window.partitionBy("symbol", "feature").orderBy("x")
    shift = F.min_by("x", "bar_ts").over(Window.partitionBy("symbol", "feature"))
    moved = long.withColumn("shift", shift).withColumn("block", F.floor((F.row_number().over(by_value) - 1) / SortedBlocks.SIZE))
    blocks = moved.groupBy("symbol", "feature", "block").agg(F.first("shift").alias("shift"), F.sort_array(F.collect_list(F.col("x") - F.col("shift"))).alias("values"))
    wanted = [f.split()[0] for f in _SEED.split(", ")]
    every = numbers.join(windows, "symbol").unionByName(blocks, allowMissingColumns=True)
    return every.select(*wanted)


def live_features(bars: DataFrame, history: DataFrame | None = None, funding: DataFrame | None = None, warmup: int = 200, state: DataFrame | None = None) -> DataFrame:
    """(symbol, bar_ts, eight features) of each bar of a stream, as feature_frame gives them for all bars at once.

    bars: a stream (symbol, high, low, close, volume, event_ts and, if there, funding). history: a batch table of the bars
    before it, with the funding rates of their times, from which the state is seeded; or state: what feature_state makes of them. Bars at or before the last one of their
    symbol are dropped, as are repeats. NaN is taken as missing. Runs on the RocksDB state store (see rocksdb_state).
    """
    wanted = ["high", "low", "close", "volume"]
    rate = F.col("funding") if "funding" in bars.columns else F.lit(0.0)
    keyed = bars.select("symbol", F.unix_millis("event_ts").alias("ms"), *wanted, rate.alias("funding")).groupBy("symbol")
    if state is None and history is not None:
        state = feature_state(history, funding)
    made = keyed.transformWithStateInPandas(FeatureState(warmup), _OUT, "Append", "None", None if state is None else state.groupBy("symbol"))
    return made.select("symbol", F.timestamp_millis("ms").alias("bar_ts"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in FEATURES])


def feature_updates(bars: DataFrame, history: DataFrame, funding: DataFrame, path: str, checkpoint: str, warmup: int = 200):
    """Start a query that appends the feature rows of new bars to path/features; it goes on from its checkpoint.

    bars: a stream (symbol, open, high, low, close, volume, event_ts); history: the bars before it. The state after them is
    worked out by a batch job and stored before the first micro-batch; a later start reads no history. A micro-batch touches its
    own bars and the state of their symbols; its time doesn't follow the history's length. It reads funding, a stored table.
    """
    from barspan.streaming.bars import with_funding

    spark = bars.sparkSession
    state = spark.createDataFrame([], _SEED) if has_batches(spark, checkpoint) else stored(feature_state(history, funding), "feature-state")
    made = live_features(with_funding(bars, funding), warmup=warmup, state=state).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))
    with rocksdb_state(spark):
        return made.writeStream.format("parquet").option("path", f"{path}/features").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
