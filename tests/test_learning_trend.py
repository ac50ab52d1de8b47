"""The significance of a trend of wins, against its SQL and against known values of Student's t."""

import datetime as dt

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE, QUERIES


def test_significance_of_few_and_many_wins(spark, tmp_path):
    at = dt.datetime(2024, 1, 5)
    wins = {3: (0, 1, 1), 4: (0, 1, 1, 2), 5: (0, 1, 2, 0, 1), 6: (2, 1, 1, 1, 0, 0), 7: (1, 0, 2) * 167, 8: (0, 2, 1) * 200, 9: (0, 0, 0), 10: (0, 1)}
    rows = [(u, i, k) for u, ks in wins.items() for i, k in enumerate(ks)]
    rows = [(n, at + dt.timedelta(minutes=i), u, "view", 1.0, f'{{"k": {k}}}') for n, (u, i, k) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["learning_trend"](spark, str(tmp_path))
    found = sorted(map(tuple, df.collect()))
    assert found == sorted(con.sql(f"select {', '.join(df.columns)} from ({ORACLE['learning_trend']})").fetchall())
    got = {r[0]: r[df.columns.index("improvement_significance")] for r in found}
    # one degree of freedom: r = sqrt(3) / 2, so 2 / pi * asin(r) = 2 / 3; two: 1 - p = r = sqrt(0.9)
    assert got[3] == pytest.approx(2 / 3, abs=1e-4) and got[4] == pytest.approx(0.9**0.5, abs=1e-4)
    assert got[9] == 0 and 10 not in got
