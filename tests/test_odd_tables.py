"""Queries against their SQL on small odd tables, and operators on values that only their last bits tell apart."""

import datetime as dt
import math

import duckdb
import pytest

from tidemark.operators import profiles, transactions
from tidemark.plans.catalog import ORACLE, QUERIES

AT = dt.datetime(2024, 1, 5)


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Bets of nothing, and times whose nearest second is the next one."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, AT + dt.timedelta(hours=i % 5, microseconds=i * 499_999), i % 4, ("signup", "view", "click", "purchase")[i % 4], 0.0 if i in (3, 8) else 1.5 * i, f'{{"k": {i}}}') for i in range(40)]
    rows += [(40, AT + dt.timedelta(seconds=0.6), 9, "view", 2.0, '{"k": 1}'), (41, AT + dt.timedelta(seconds=86400.7), 9, "view", 2.0, '{"k": 2}'), (42, AT + dt.timedelta(seconds=86401.5), 9, "view", 2.0, '{"k": 3}')]
    rows += [(43 + i, AT + dt.timedelta(seconds=s), 10, "view", 1.0, '{"k": 3}') for i, s in enumerate((0.4, 86400.6, 172800.2))]  # constant wins
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["feature_registry", "learning_trend", "frequency_cap"])
def test_odd_events_match_duckdb(spark, odd_events, name):
    df = QUERIES[name](spark, odd_events)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{odd_events}/events.parquet/*.parquet'")
    columns = ", ".join(df.columns)
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(df.collect()) == plain(con.sql(f"select {columns} from ({ORACLE[name]})").fetchall())


def test_significance_of_a_trend_without_numbers(spark, odd_events):
    rows = {r.user_id: r for r in QUERIES["trend_significance"](spark, odd_events).collect()}
    assert math.isnan(rows[3].improvement_significance) and math.isnan(rows[0].improvement_significance)
    assert not math.isnan(rows[3].escalation_significance) and 0 <= rows[1].improvement_significance <= 1
    assert rows[10].escalation_significance == rows[10].improvement_significance == 0


def test_equal_sums_have_equal_scores(spark):
    rows = [(u, a, AT) for u, amounts in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for a in amounts]
    df = spark.createDataFrame(rows, "user_id long, amount double, created_at timestamp").coalesce(1)
    assert {r.monetary_score for r in transactions.rfm(df, AT).collect()} == {1}


def test_rhythm_of_equal_neighbours(spark):
    """Two places of the spectrum are equal, and higher than both sides, in whatever order the hours come."""
    counts = (3, 1, 4, 2, 1, 1, 3, 0, 3, 2, 0, 7, 4, 5, 1, 4, 4, 3, 3, 3, 5, 6, 4, 2)
    hours = [h for h, n in enumerate(counts) for _ in range(n)]
    turned = lambda u: sorted(hours, key=lambda h: (h * (2 * u + 1) + u) % 29)
    rows = [(u, AT.replace(hour=h)) for u in range(60) for h in turned(u)]
    rows += [(100 + h, AT.replace(hour=h)) for h in range(24) for _ in range(3)]  # all places are equal
    df = spark.createDataFrame(rows, "user_id long, timestamp timestamp")
    assert {(r.user_id >= 100, r.rhythm_peaks) for r in profiles.rhythm(df).collect()} == {(False, 3 / 11), (True, 0.0)}


def test_daily_metrics_keep_one_sketch_a_day(spark):
    from tidemark.operators import alerts

    rows = [(u, 10.0 * i, "completed", "bet", float(i % 7), AT + dt.timedelta(days=d)) for d in range(2) for i, u in enumerate((1, 1, 2, None))]
    rows += [(None, 1.0, "failed", "bet", 1.0, AT + dt.timedelta(days=2))]
    df = alerts.daily_metrics(spark.createDataFrame(rows, "user_id long, amount double, status string, transaction_type string, delay double, created_at timestamp"))
    assert not [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "percentile_approx" in x and "user_id" in x.split("functions=")[0]]
    assert sorted(r.value for r in df.where("metric = 'active_users'").collect()) == [0.0, 2.0, 2.0]
