"""Spectra of which the last bits of sums decide a peak, against the SQL of the query."""

import datetime as dt

import duckdb

from tidemark.plans.catalog import ORACLE, QUERIES

# In whatever order the hours of these counts are added, the higher of two nearly equal neighbours is the same.
COUNTS = (
    (3, 2, 3, 2, 4, 1, 2, 2, 3, 0, 1, 3, 3, 3, 2, 3, 3, 2, 2, 3, 2, 2, 2, 0),
    (4, 4, 1, 2, 2, 2, 2, 3, 3, 1, 2, 4, 2, 2, 1, 1, 5, 5, 3, 1, 1, 3, 3, 0),
    (4, 4, 4, 2, 1, 4, 3, 2, 0, 2, 3, 1, 3, 2, 3, 3, 1, 1, 1, 1, 4, 4, 2, 2),
    (3, 1, 4, 2, 1, 1, 3, 0, 3, 2, 0, 7, 4, 5, 1, 4, 4, 3, 3, 3, 5, 6, 4, 2),
)


def test_equal_neighbours_on_a_slope(spark, tmp_path):
    at = dt.datetime(2024, 1, 5)
    hours = [(u, h) for u, counts in enumerate(COUNTS) for h, n in enumerate(counts) for _ in range(n)]
    rows = [(i, at.replace(hour=h), u, "view", 1.0, '{"k": 1}') for i, (u, h) in enumerate(sorted(hours, key=lambda x: x[1] * 7 % 24))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["rhythm"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"select {', '.join(df.columns)} from ({ORACLE['rhythm']})").fetchall())
