"""Expanding winsorised z-scores of one long series over many tasks: values where a percentile may fall, sums elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.operators.divided import KEY, chunks, cut
from barspan.operators.order_stats import SortedBlocks, winsor_z_next

SERIES = ["symbol", "feature"]
OWN, KNOWN, CLOSED = 0, 1, 2


def numbered_values(rows: DataFrame, columns: list[str], span: str, size: int) -> DataFrame:
    """(symbol, feature, bar_ts, x, part): finite values less the first of their series, `size` of them in time a part.

    Numbers and first values come from chunks of time and are carried over chunks, so that no task reads more than a chunk.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = chunks(rows, span).select(*KEY, "bar_ts", F.inline(pairs)).filter("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    over = Window.partitionBy(*SERIES).orderBy("_chunk")
    counts = long.groupBy(*KEY, "feature").agg(F.count("*").alias("n"), F.min_by("x", "bar_ts").alias("first"))
    before = counts.select(*KEY, "feature", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.first("first").over(over).alias("_shift"))
    at = long.withColumn("_i", F.row_number().over(Window.partitionBy(*KEY, "feature").orderBy("bar_ts"))).join(before, [*KEY, "feature"])
    return at.select(*SERIES, "bar_ts", (F.col("x") - F.col("_shift")).alias("x"), F.floor((F.col("_before") + F.col("_i") - 1) / size).alias("part"))


def rank_windows(n: int, size: int, lo: float, hi: float) -> list[tuple[int, int]]:
    """Ranks among n sorted values within which both percentiles stay while `size` more values come, ends included."""
    return [(int(p * (n - 1)) - size - 1, int(p * (n + size - 1)) + 3) for p in (lo, hi)]


def _plan(size: int, lo: float, hi: float):
    """For each part of a series: the buckets before it whose values it needs, and sums over each run of other buckets."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        n_buckets = cells["at"].max() + 1
        n, total, square, least = np.zeros(n_buckets, np.int64), np.zeros(n_buckets), np.zeros(n_buckets), np.full(n_buckets, np.inf)
        out, names = [], ["part", "bucket", "x", "n", "total", "square"]
        bucket_of = cells.drop_duplicates("at").set_index("at")["bucket"]
        for part, new in cells.sort_values("part").groupby("part", sort=True):
            ends = n.cumsum()
            spans, closed = rank_windows(int(ends[-1]), size, lo, hi), None
            for b in np.flatnonzero(n):
                if any(ends[b] > a and ends[b] - n[b] <= z for a, z in spans):
                    out.append((part, bucket_of[b], least[b], 0, 0.0, 0.0))
                    closed = None
                elif closed is None:
                    out.append((part, -1, least[b], n[b], total[b], square[b]))
                    closed = len(out) - 1
                else:
                    was = out[closed]
                    out[closed] = (*was[:3], was[3] + n[b], was[4] + total[b], was[5] + square[b])
            at = new["at"].to_numpy()
            n[at] += new["n"].to_numpy()
            total[at] += new["total"].to_numpy()
            square[at] += new["square"].to_numpy()
            least[at] = np.minimum(least[at], new["least"].to_numpy())
        made = pd.DataFrame(out, columns=names)
        return made.assign(symbol=cells["symbol"].iloc[0], feature=cells["feature"].iloc[0])[[*SERIES, *names]]

    return run


def history_before(values: np.ndarray, closed: np.ndarray) -> SortedBlocks:
    """Order statistics of the values before a part, from sorted ones and from sums (least, n, total, square) of closed runs."""
    index, blocks = [[-1.0 - i, *r] for i, r in enumerate(closed)], []
    for between in np.split(values, np.searchsorted(values, np.sort(closed[:, 0]))):  # open values never surround a closed run within a block
        for i in range(0, len(between), SortedBlocks.SIZE):
            index.append(SortedBlocks.entry(len(blocks), between[i : i + SortedBlocks.SIZE]))
            blocks.append(between[i : i + SortedBlocks.SIZE])
    index.sort(key=lambda e: e[1])
    return SortedBlocks(blocks.__getitem__, np.array(index, float).reshape(-1, 5))


def _score(warmup: int, lo: float, hi: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, closed = pdf[pdf["kind"] == KNOWN].sort_values("x"), pdf[pdf["kind"] == CLOSED]
        values = np.repeat(known["x"].to_numpy(float), known["n"].to_numpy(np.int64))
        history = history_before(values, closed[["x", "n", "total", "square"]].to_numpy(float))
        own = pdf[pdf["kind"] == OWN].sort_values("bar_ts")
        z = [winsor_z_next(history, x, warmup, lo, hi) for x in own["x"].tolist()]
        return own[[*SERIES, "bar_ts"]].assign(z=pd.array(z, dtype="Float64"))

    return run


def winsor_scores(rows: DataFrame, columns: list[str], span: str, size: int = 4096, warmup: int = 200, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(symbol, feature, bar_ts, z) of the columns' finite values, as winsor_z scores them; no task holds a whole series.

    A series is cut into parts of `size` values in time, each a task. While a part comes in, either percentile moves over few
    more than 2 * size ranks of the values before it; those come from range partitions by value, each value once with its
    count, and all others as sums of count, value and square over runs of partitions. What a part needs follows from
    counts by part and partition: a series of n values has (n / size)^2 of them, which come together once, so that `size`
    should be the root of n or more. Time is in proportion to the values.
    """
    numbered = cut(numbered_values(rows, columns, span, size), "score-values")
    n_buckets = max(1, -(-numbered.count() // size))
    by_value = numbered.groupBy(*SERIES, "part", "x").agg(F.count("*").alias("n"))
    ranged = cut(by_value.repartitionByRange(n_buckets, *SERIES, "x").withColumn("bucket", F.spark_partition_id()), "score-buckets")
    cells = ranged.groupBy(*SERIES, "bucket", "part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("total"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("square"), F.min("x").alias("least"))
    placed = cells.withColumn("at", F.dense_rank().over(Window.partitionBy(*SERIES).orderBy("bucket")) - 1)
    planned = cut(placed.groupBy(*SERIES).applyInPandas(_plan(size, lo, hi), "symbol string, feature string, part long, bucket int, x double, n long, total double, square double"), "score-plan")
    wanted = planned.filter("bucket >= 0").select(*SERIES, "bucket", F.col("part").alias("of"))
    known = ranged.join(wanted, [*SERIES, "bucket"]).filter("part < of").groupBy(*SERIES, F.col("of").alias("part"), "x").agg(F.sum("n").alias("n"))
    none = F.lit(None)
    every = (
        numbered.select(*SERIES, "part", F.lit(OWN).alias("kind"), "bar_ts", "x", none.cast("long").alias("n"), none.cast("double").alias("total"), none.cast("double").alias("square"))
        .unionByName(known.withColumn("kind", F.lit(KNOWN)), allowMissingColumns=True)
        .unionByName(planned.filter("bucket < 0").drop("bucket").withColumn("kind", F.lit(CLOSED)), allowMissingColumns=True)
    )
    return every.groupBy(*SERIES, "part").applyInPandas(_score(warmup, lo, hi), "symbol string, feature string, bar_ts timestamp_ntz, z double")
