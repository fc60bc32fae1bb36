"""Raking to shares far below the tolerance."""

import warnings

import pytest

from barspan.llm.mixing import rake

CELLS = [("a", "x", 5e8), ("b", "x", 5e8), ("a", "y", 5e8), ("b", "y", 5e8), ("t", "u", 900.0), ("t", "x", 10.0), ("a", "u", 50.0)]


def tables(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, tokens double")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    return cells, {"source": share({"a": 0.5, "b": 0.5 - 1e-7, "t": 1e-7}), "lang": share({"x": 0.5, "y": 0.5 - 2e-7, "u": 2e-7})}


def test_small_shares_are_reached(spark):
    cells, targets = tables(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        w = rake(cells, targets).toPandas()
    assert w.groupby("source")["weight"].sum()["t"] == pytest.approx(1e-7, rel=1e-5)
    assert w.groupby("lang")["weight"].sum()["u"] == pytest.approx(2e-7, rel=1e-5)


def test_sweeps_that_run_out_are_reported(spark):
    with pytest.warns(UserWarning, match="sweeps"):
        rake(*tables(spark), max_sweeps=1)
