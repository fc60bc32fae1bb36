"""Covariances in tiles against rows of pairs."""

import datetime as dt
import random

import numpy as np

from barspan.operators import risk as V
from barspan.operators.tiles import Tile, covariance_tiles, symbol_numbers, tile_distances, tile_pairs


def returns(spark, n=90, symbols=7):
    """Symbols that come late, miss bars, and one with a single return."""
    rnd, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(f"S{s}", t0 + dt.timedelta(days=i), None if rnd.random() < 0.05 else rnd.gauss(5 if s == 2 else 0, 0.01)) for s in range(symbols) for i in range(10 * s, n) if rnd.random() < 0.9]
    return spark.createDataFrame(rows + [("T", t0 + dt.timedelta(days=3), 0.5)], "symbol string, bar_ts timestamp_ntz, ret double").repartition(4)


def test_tiles_equal_pairs(spark):
    df = returns(spark)
    numbers = symbol_numbers(df)
    want = {(r["bar_ts"], r["sym_i"], r["sym_j"]): (r["cov"], r["n"]) for r in V.rolling_covariance(df, 20).collect()}
    for block in (3, 32):
        tiles = covariance_tiles(df, numbers, 20, block)
        got = {(r["bar_ts"], r["sym_i"], r["sym_j"]): (r["cov"], r["n"]) for r in tile_pairs(tiles, numbers, block).collect()}
        assert set(got) == set(want)
        assert all(got[k][1] == n and abs(got[k][0] - c) < 1e-10 for k, (c, n) in want.items())
    distances = {r["bar_ts"]: (r["n"], r["d2"]) for r in V.mahalanobis(V.rolling_covariance(df, 20), df).collect()}
    made = {r["bar_ts"]: (r["n"], r["d2"]) for r in tile_distances(covariance_tiles(df, numbers, 20, 3), df, numbers, 3).collect()}
    assert set(made) == set(distances)
    for k, (n, d2) in distances.items():
        assert made[k][0] == n and (made[k][1] is None) == (d2 is None)
    assert covariance_tiles(df.limit(0), symbol_numbers(df.limit(0)), 20, 3).count() == 0


def test_a_tile_of_many_symbols_keeps_its_sums():
    rng = np.random.default_rng(3)
    tile, kept = Tile(8, 25), []
    for _ in range(400):
        x = rng.normal(size=8) / 100 + 3
        kept.append(x)
        cov, n = tile.move(x, x, True)
    assert np.allclose(cov, np.cov(np.array(kept[-25:]).T), atol=1e-12) and (n == 25).all()
