"""What shows on larger tables only: long step numbers, arrivals that tie, bars that share a time, tables read once."""

import datetime as dt
from collections import Counter

import numpy as np

import __spark_entry__
from barspan.operators import grid as G
from barspan.plans import fixtures as X
from barspan.plans.source_plans import _landed
from barspan.sources import readers as A
from barspan.streaming import bars as M
from tests.test_queries import norm


def test_model_versions_of_more_digits(spark, tmp_path):
    paths = [("A", "m/A/step_9999/m.pt"), ("A", "m/A/step_10000/m.pt"), ("B", "m/B/step_9999999999/m.pt"), ("B", "m/B/step_10000000000/m.pt"), ("B", "m/B/step_7/m.pt"), ("C", "m/C/step_3/m.pt"), ("C", "m/C/m.pt")]
    paths += [("D", "m/D/step_0012/m.pt"), ("D", "m/D/step_12/m.pt"), ("D", "m/D/step_011/m.pt")]
    got = dict(A.latest_model_version(spark.createDataFrame(paths, "symbol string, path string")).collect())
    assert got == {"A": "m/A/step_10000/m.pt", "B": "m/B/step_10000000000/m.pt", "C": "m/C/m.pt", "D": "m/D/step_12/m.pt"}


def test_latest_model_version_beyond_four_digits_equals_its_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (select i as s_suppkey from range(12345) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    got = __spark_entry__.queries()["a11_latest_model_version"](spark, str(tmp_path)).select("symbol", "path").collect()
    want = con.execute(__spark_entry__.oracle_sql()["a11_latest_model_version"]).fetchall()
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)


def test_landed_parts_hold_each_row_once_however_ties_come(spark, tmp_path):
    """The rows come in another order at each evaluation, as those of a shuffle may; a quarter of them share each time."""
    times = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = spark.createDataFrame([(f"S{i}", t, float(i)) for i in range(100) for t in times] + [("N", None, 1.0)], "symbol string, event_ts timestamp, close double")
    mixed = rows.coalesce(1).mapInPandas(lambda pdfs: (p.sample(frac=1, random_state=np.random.default_rng()) for p in pdfs), rows.schema)
    landed = M.run_available(_landed(spark, mixed, parts=3, closing=True), str(tmp_path / "out"), str(tmp_path / "state"))
    got = Counter(map(tuple, landed.collect()))
    closing = [r for r in got if r[0] == "~"]
    assert len(closing) == 1 and got - Counter(closing) == Counter(map(tuple, rows.collect()))


def test_feature_updates_work_bars_out_once(spark, tmp_path, monkeypatch):
    made, seen = X.daily_bars, tmp_path / "seen"
    seen.mkdir()

    def counted(s, d):
        bars = made(s, d)

        def note(pdfs, folder=str(seen)):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield from pdfs

        return bars.coalesce(1).mapInPandas(note, bars.schema)

    monkeypatch.setattr(X, "daily_bars", counted)
    assert __spark_entry__.queries()["e16_feature_updates"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(list(seen.iterdir())) == 1


def test_arrivals_that_tie_come_by_time_whatever_the_layout(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [("A", at[2], 10, 3.0), ("A", at[1], 10, 2.0), ("A", at[1], 10, 1.0), ("A", at[0], 0, 9.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "symbol string, bar_ts timestamp_ntz, arrival_seq long, px double").coalesce(1)
        assert sorted(r.px for r in G.drop_out_of_order(df).collect()) == [1.0, 3.0, 9.0]
        assert sorted(r.px for r in G.first_per_step(df, "1h").collect()) == [1.0, 3.0, 9.0]
        assert sorted(r.px for r in G.seen_before(df).filter("seen_before").collect()) == [2.0]
