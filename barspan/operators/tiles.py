"""Rolling covariances as tiles: one array for a block of symbols by a block of symbols and bar, moved on by what comes and goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TILES = "bar_ts timestamp_ntz, tile_i int, tile_j int, cov array<double>, n array<int>"


def symbol_numbers(returns: DataFrame) -> DataFrame:
    """(symbol, at): symbols that have returns, numbered from 0 in their order."""
    names = returns.filter("ret is not null").select("symbol").distinct()
    # One row a symbol; the order over symbols is global.
    return names.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1).alias("at"))


class Tile:
    """Sums over the last `window` common bars of each pair of two blocks. Each pair has its own bars, as either may lack some.

    Values are taken less the first of their pair; every `window` bars the sums are taken anew from what is held, so
    that rounding errors of what came and went can't add up. Memory is block * block * window pairs of numbers.
    """

    def __init__(self, block: int, window: int):
        self.window, self.bars = window, 0
        self.held = np.zeros((2, window, block, block))
        self.first = np.full((2, block, block), np.nan)
        self.seen = np.zeros((block, block), np.int64)
        self.sums = np.zeros((3, block, block))  # of x, y and their product

    def move(self, x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Covariances and counts after a bar; NaN and 0 for pairs of which it lacks one."""
        a, b = np.nonzero(np.isfinite(x)[:, None] & np.isfinite(y)[None, :])
        new = np.isnan(self.first[0, a, b])
        self.first[0, a[new], b[new]], self.first[1, a[new], b[new]] = x[a[new]], y[b[new]]
        u, v, place = x[a] - self.first[0, a, b], y[b] - self.first[1, a, b], self.seen[a, b] % self.window
        gone_u, gone_v = self.held[0, place, a, b], self.held[1, place, a, b]  # 0 while the window fills
        for k, change in enumerate((u - gone_u, v - gone_v, u * v - gone_u * gone_v)):
            self.sums[k, a, b] += change
        self.held[0, place, a, b], self.held[1, place, a, b] = u, v
        self.seen[a, b] += 1
        self.bars += 1
        if self.bars % self.window == 0:
            self.sums[0], self.sums[1], self.sums[2] = self.held[0].sum(axis=0), self.held[1].sum(axis=0), (self.held[0] * self.held[1]).sum(axis=0)
        n = np.minimum(self.seen[a, b], self.window)
        cov, counts = np.full(self.seen.shape, np.nan), np.zeros(self.seen.shape, np.int32)
        sample = (self.sums[2, a, b] - self.sums[0, a, b] * self.sums[1, a, b] / n) / np.maximum(n - 1, 1)
        alone = np.where(same & (a == b), x[a] * y[b], 0.0)  # one common bar: the squared return on the diagonal
        cov[a, b], counts[a, b] = np.where(n > 1, sample, alone), n
        return cov, counts


def _moved(block: int, window: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tile, bar, x, y, out = None, None, None, None, None, []

        def close() -> None:
            cov, n = tile.move(x, x if key[0] == key[1] else y, key[0] == key[1])
            out.append((bar, *key, cov.ravel(), n.ravel()))

        for pdf in pdfs:
            for i, j, ts, at, ret in zip(pdf["tile_i"].tolist(), pdf["tile_j"].tolist(), pdf["bar_ts"], pdf["at"].tolist(), pdf["ret"].tolist(), strict=True):
                if (i, j) != key or ts != bar:
                    if key is not None:
                        close()
                        if len(out) * block * block > 1 << 18:
                            yield pd.DataFrame(out, columns=["bar_ts", "tile_i", "tile_j", "cov", "n"])
                            out = []
                    if (i, j) != key:
                        key, tile = (i, j), Tile(block, window)
                    bar, x, y = ts, np.full(block, np.nan), np.full(block, np.nan)
                (x if at // block == i else y)[at % block] = ret
        if key is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=["bar_ts", "tile_i", "tile_j", "cov", "n"])

    return run


def covariance_tiles(returns: DataFrame, numbers: DataFrame, window: int = 250, block: int = 32) -> DataFrame:
    """(bar_ts, tile_i, tile_j, cov, n) for tile_i <= tile_j: rolling_covariance in arrays of block * block, row by row.

    A row of returns goes to the tiles of its block, symbols / block of them; no pair of symbols is a row. Entries are null
    (n: 0) where a bar lacks either return. A tile is a stream of bars in one task; tiles run in parallel.
    """
    rows = returns.filter("ret is not null").join(numbers, "symbol").select("bar_ts", "at", "ret", F.floor(F.col("at") / block).cast("int").alias("tile"))
    last = numbers.agg(F.max("at")).first()[0] or 0  # one number
    other = rows.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(last // block))))
    placed = other.select(F.least("tile", "_u").alias("tile_i"), F.greatest("tile", "_u").alias("tile_j"), "bar_ts", "at", "ret")
    ordered = placed.repartition("tile_i", "tile_j").sortWithinPartitions("tile_i", "tile_j", "bar_ts", "at")
    made = ordered.mapInPandas(_moved(block, window), _TILES)
    return made.withColumn("cov", F.transform("cov", lambda v: F.when(~F.isnan(v), v)))


def tile_pairs(tiles: DataFrame, numbers: DataFrame, block: int = 32) -> DataFrame:
    """(bar_ts, sym_i, sym_j, cov, n): the entries of tiles as rows of pairs, as rolling_covariance has them."""
    cells = tiles.select("bar_ts", "tile_i", "tile_j", F.posexplode(F.arrays_zip("cov", "n")).alias("p", "c")).filter("c.cov is not null")
    at = lambda tile, inside: F.col(tile) * block + inside
    rows = cells.select("bar_ts", at("tile_i", F.floor(F.col("p") / block)).alias("_i"), at("tile_j", F.col("p") % block).alias("_j"), "c.cov", F.col("c.n").cast("long").alias("n")).filter("_i <= _j")
    named = lambda name, k: numbers.select(F.col("symbol").alias(name), F.col("at").alias(k))
    return rows.join(named("sym_i", "_i"), "_i").join(named("sym_j", "_j"), "_j").select("bar_ts", "sym_i", "sym_j", "cov", "n")


def tile_distances(tiles: DataFrame, returns: DataFrame, numbers: DataFrame, block: int = 32) -> DataFrame:
    """(bar_ts, n, d2): as risk.mahalanobis, from tiles: a bar's matrix is put together in one task from arrays, never from pairs."""
    row = F.sort_array(F.collect_list(F.struct("at", "ret")))
    rets = returns.filter("ret is not null").join(numbers, "symbol").groupBy("bar_ts").agg(row.alias("r"))
    whole = tiles.groupBy("bar_ts").agg(F.collect_list(F.struct("tile_i", "tile_j", "cov")).alias("t")).join(rets, "bar_ts")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for ts, found, r in zip(pdf["bar_ts"], pdf["t"], pdf["r"], strict=True):
                at = np.array([x["at"] for x in r])
                size = (max(x["tile_j"] for x in found) + 1) * block
                m = np.full((size, size), np.nan)
                for x in found:
                    a, b = x["tile_i"] * block, x["tile_j"] * block
                    c = np.array(x["cov"], float).reshape(block, block)
                    m[a : a + block, b : b + block] = c
                    m[b : b + block, a : a + block] = c.T
                m, v = m[np.ix_(at, at)], np.array([x["ret"] for x in r])
                out.append((ts, len(at), float(v @ np.linalg.pinv(m) @ v) if np.isfinite(m).all() else None))
            yield pd.DataFrame(out, columns=["bar_ts", "n", "d2"]).astype({"d2": float})

    made = whole.mapInPandas(run, "bar_ts timestamp_ntz, n long, d2 double")
    return made.withColumn("d2", F.when(~F.isnan("d2"), F.col("d2")))
