"""Folds in event time: cuts in batches, restarts, late rows and the end of state; stored marks and centres."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.files import extract_increment
from tidemark.sources.shared import StateLog
from tidemark.streaming import ingest, stateful

SCHEMA = "user_id long, transaction_id long, created_at timestamp, transaction_type string, amount double, _own string"
START = dt.datetime(2024, 1, 1)
END = (-1, -1, dt.datetime(2100, 1, 1), "bet", 0.0, "x")


def _tx(n, seed=1):
    rng = random.Random(seed)
    out = [(rng.choice([1, 1, 2, None]), i, START + dt.timedelta(seconds=rng.randrange(40_000)), rng.choice(["bet", "deposit", "win"]), rng.choice([None, 1.0, 2.5]), "x") for i in range(n)]
    return out + [(1, n, out[0][2], "bet", 4.0, "x")]  # a tie


def _run(spark, tmp_path, plan, parts, name="s"):
    """Each part is a file; the query is stopped and started again from its checkpoint after each of them."""
    out = str(tmp_path / f"{name}-out")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        with stateful.rocksdb(spark):
            made = plan(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"{name}-in")))
            run = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-offsets")).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def test_balances_whatever_the_batches_and_restarts(spark, tmp_path):
    rows = _tx(40)
    by_time = sorted(rows, key=lambda r: r[2])
    parts = [by_time[:20], by_time[20:], [END]]
    parts[0], parts[1] = parts[0][:17] + [parts[1][0]], parts[0][17:] + parts[1][1:]  # out of order, within the delay
    found = {(r.user_id, r.transaction_id): r.balance for r in _run(spark, tmp_path, lambda df: stateful.balances(df, "6 hours"), parts).collect()}
    expected, now = {}, {}
    for u, i, _, kind, amount, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        now[u] = now.get(u, 0.0) + (amount or 0.0) * (1 if kind in ("deposit", "win") else -1)
        expected[u, i] = now[u]
    assert found == expected


def test_last_features_end_with_their_time(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, 0, at(0), "bet", 1.0, "x"), (1, 1, at(3), "bet", None, "x"), (1, 2, at(8), "bet", 3.0, "x"), (1, 3, at(14), "bet", 4.0, "x"), (2, 4, at(4), "bet", 5.0, "x")]
    plan = lambda df: stateful.last_features(df, ["amount"], dt.timedelta(minutes=5), "1 minute")
    found = {r.transaction_id: (r.last_amount, r.age) for r in _run(spark, tmp_path, plan, [rows[:2] + rows[4:], rows[2:4], [END]]).collect()}
    assert found == {0: (None, None), 1: (1.0, 180.0), 2: (None, 300.0), 3: (None, None), 4: (None, None)}


def test_alerts_are_those_of_the_table(spark, tmp_path):
    from tidemark.operators.quality import quality_alerts

    rows = _tx(60, 3)
    metrics = lambda df: df.select(F.coalesce(F.col("user_id"), F.lit(0)).cast("string").alias("dimension"), F.col("created_at").alias("ts"), (F.coalesce("amount", F.lit(2.0)) / 4).alias("score"))
    by_time = sorted(rows, key=lambda r: r[2])
    plan = lambda df: stateful.alerts(metrics(df), "1 hour", cooldown=dt.timedelta(minutes=50))
    late = (1, 99, START - dt.timedelta(days=9), "bet", 0.1, "x")  # later than the watermark: dropped
    found = _run(spark, tmp_path, plan, [by_time[:40], [*by_time[40:], late], [END]]).where("raised < timestamp '2099-01-01'")
    expected = quality_alerts(metrics(spark.createDataFrame(rows, SCHEMA)), cooldown_minutes=50)
    assert sorted((r.dimension, r.severity, r.raised) for r in found.collect()) == sorted((r.dimension, r.severity, r.ts) for r in expected.collect())


def test_state_is_of_buckets_and_ids_stay_whole(spark, tmp_path):
    users = [None, 2**60, 2**60 + 1, *range(40)]  # doubles would not tell the large ones apart
    rows = [(u, i, START + dt.timedelta(seconds=i), "win", 1.0, "x") for i, u in enumerate(users * 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([END], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    count = lambda state, r: ((state[0] + 1 if state else 1,), (r["transaction_id"], state[0] + 1 if state else 1))
    with stateful.rocksdb(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = stateful.in_order(stream, ["user_id"], "created_at", count, "n long", "transaction_id long, n long", "1 hour", buckets=2)
        run = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = sorted((r.transaction_id, r.user_id, r.n) for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect() if r.user_id != -1)
    assert found == [(i, u, 1 + i // len(users)) for i, (u, *_) in enumerate(rows)]
    # a chunk of rows, the states and a timer of each bucket, however many keys there are
    assert max(s.numRowsTotal for p in run.recentProgress for s in p.stateOperators) <= 8


def test_centres_go_on_after_a_restart_and_a_batch_counts_once(spark, tmp_path):
    batch = lambda seed: spark.createDataFrame([(float(random.Random(seed * 100 + i).gauss(seed % 2 * 10, 1)),) for i in range(50)], "x double")
    plain = ingest.OnlineKMeans(2, ["x"])
    for i in range(3):
        plain.learn(batch(i))
    log = str(tmp_path / "log")
    for i in (0, 1, 1, 0, 2):  # a new object each time, some batches handed over again
        ingest.OnlineKMeans(2, ["x"], log=StateLog(spark, log)).learn(batch(i), i)
    again = ingest.OnlineKMeans(2, ["x"], log=StateLog(spark, log))
    assert (again.centres, again.weights, again.n, again.batches) == (plain.centres, plain.weights, plain.n, 3)


def test_marks_move_when_the_sink_is_done(spark, tmp_path):
    log, got = StateLog(spark, str(tmp_path / "marks")), []
    df = lambda n: spark.createDataFrame([(i, START + dt.timedelta(minutes=i)) for i in range(n)] + [(99, None)], "i long, at timestamp")
    sink = lambda x: got.append(sorted(r.i for r in x.collect()))
    assert extract_increment(df(3), "at", log, sink) == 3 and extract_increment(df(3), "at", log, sink) == 0
    with pytest.raises(ZeroDivisionError):
        extract_increment(df(5), "at", log, lambda x: 1 / 0)
    assert extract_increment(df(6), "at", StateLog(spark, str(tmp_path / "marks")), sink) == 3
    assert got == [[0, 1, 2], [3, 4, 5]]
    assert extract_increment(df(3), "at", StateLog(spark, str(tmp_path / "other")), sink, START + dt.timedelta(minutes=1)) == 1
    with pytest.raises(RuntimeError):
        log.put(log.last()[0], "x")


def test_features_from_after_the_event_do_not_leak(spark):
    events = spark.createDataFrame([(1, START), (2, START)], "user_id long, ts timestamp")
    features = spark.createDataFrame([(1, START + dt.timedelta(seconds=1), 5), (2, START - dt.timedelta(seconds=1), 7)], "user_id long, updated_at timestamp, n int")
    assert sorted(tuple(r) for r in ingest.enrich_stream(events, features, "ts").select("user_id", "n").collect()) == [(1, None), (2, 7)]
