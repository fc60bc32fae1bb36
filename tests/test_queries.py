"""Registered queries against DuckDB on the smallest tables, where that is quick."""

import math

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [
    "a01_read_bars", "a04_decode_klines", "b04_align", "d01_first_per_step", "d05_missing_bars", "d12_locf", "e03_matrix_by_time", "e05_tsmom", "e08_rsi_innovation", "e10_atr_innovation", "e19_supervised_sequences",
    "f06_select_universe", "g02_garch_variance", "g06_rolling_covariance", "h02_exposure_caps", "h12_generate_orders", "i01_walk_forward_folds", "i07_forecast_metrics", "j03_position_ledger", "j08_equity_curve",
    "a15_default_filters", "a17_risk_series", "c04_in_universe", "e15_raw_features", "e17_feature_frame", "i04_standardizer_json", "i06_prediction_table", "l03_mean_rolling_error", "m02_history_then_live", "m04_late_bars",
    "k02_performance_summary", "m05_stream_gaps", "m05_silent_symbols", "m06_live_features", "m06_live_momentum", "m07_next_funding", "m08_stream_dollar_volume", "m08_universe_refresh", "m09_stream_bars", "m09_sliding_bars",
    "e16_feature_updates",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-6 else "0"
    return str(v)


def same(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted([norm(r[c]) for c in columns] for r in got.collect())
    b = sorted([norm(v) for v in r] for r in want.fetchall())
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
