"""Events beyond 1,000,003, where arrival_seq repeats: results are those of the SQL with an order of arrival that is complete."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

ORDERS = {"d01_first_per_step": "arrival_seq, px", "d02_drop_out_of_order": "arrival_seq, bar_ts, px", "d04_seen_before": "arrival_seq, symbol, px"}


@pytest.mark.parametrize("name", ORDERS)
def test_tied_arrivals_follow_the_sql_with_a_complete_order(spark, tmp_path, name):
    path = tmp_path / "events.parquet"
    db = duckdb.connect()
    db.sql(f"COPY (SELECT e.* REPLACE (event_id + 1000003 * k AS event_id, ts + to_hours(7 * k) AS ts, value + 0.01 * k AS value) FROM '/root/testdata/sf0.001/events.parquet' e, range(3) AS t(k)) TO '{path}' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS FROM '{path}'")
    sql = __spark_entry__.oracle_sql()[name]
    complete = sql.replace("ORDER BY arrival_seq", f"ORDER BY {ORDERS[name]}")
    assert complete != sql
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter(db.sql(f"SELECT {', '.join(got.columns)} FROM ({complete})").fetchall())
