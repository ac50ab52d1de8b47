"""Stored tables that are changed by buckets: versions, repeated batches, deletion, and streams that begin again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.sources.buckets import BucketTable, stream_into
from tidemark.streaming import ingest

SCHEMA = "k long, v string, n int, updated_at timestamp"
AT = dt.datetime(2024, 1, 2)


def _rows(spark, *rows):
    return spark.createDataFrame([(k, v, n, None) for k, v, n in rows], SCHEMA)


def _found(table):
    return sorted((r.k, r.v, r.n) for r in table.read().collect())


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable.create(_rows(spark, *[(i, f"v{i}", i) for i in range(200)]), path, "k", 16)
    before = _files(path)
    one = _rows(spark, (3, "new", 1), (3, "newer", 2))
    table = table.upsert(one.select("k", "v", "n"), AT, order="n")
    assert len(_files(path) - before) == 1  # one bucket was written
    assert [x for x in _found(table) if x[0] == 3] == [(3, "newer", 2)] and len(_found(table)) == 200
    assert table.read().where("k = 3").first().updated_at == AT and table.read().where("k = 4").first().updated_at is None
    table = table.update(_rows(spark, (5, None, 50), (999, "unknown", 1)).select("k", "v", "n"))
    assert [x for x in _found(table) if x[0] == 5] == [(5, "v5", 50)] and len(_found(table)) == 200
    table = table.delete(spark.createDataFrame([(i,) for i in range(100, 200)], "k long"))
    assert len(_found(table)) == 100
    again = BucketTable(spark, path)
    assert again.version == 3 and _found(again) == _found(table)
    parts = again.vacuum(1)  # what all versions but the last alone named
    assert all(n[:12] in ("000000000000", "000000000001", "000000000002") for n in parts) and again.vacuum(1) == []
    assert _found(BucketTable(spark, path)) == _found(table)


def test_a_batch_counts_once_and_each_writer_for_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable.create(_rows(spark, (1, "a", 1)), path, "k", 4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"), F.sum("n").cast("int").alias("n"), F.max("updated_at").alias("updated_at"))
    for batch in (0, 0, 1, 0):
        table = table.merge(_rows(spark, (1, "a", 10), (2, "b", 5)), add, batch, "w")
    assert _found(table) == [(1, "a", 21), (2, "b", 10)]
    table = table.merge(_rows(spark, (2, "b", 1)), add, 0, "other").merge(_rows(spark), add, 2, "w")
    assert _found(table) == [(1, "a", 21), (2, "b", 11)] and BucketTable(spark, path).batches == {"w": 2, "other": 0}


def test_what_a_lost_writer_leaves_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable.create(_rows(spark, (1, "a", 1), (2, "b", 2)), path, "k", 2)
    _rows(spark, (1, "half", 0)).withColumn("_b", F.lit(0)).write.partitionBy("_b").parquet(f"{path}/data/000000000001-lost")  # no log entry followed
    assert _found(BucketTable(spark, path)) == [(1, "a", 1), (2, "b", 2)]
    late = BucketTable(spark, path)
    table = table.upsert(_rows(spark, (1, "c", 3)))
    assert _found(table) == [(1, "c", 3), (2, "b", 2)]
    with pytest.raises(RuntimeError):
        late.upsert(_rows(spark, (2, "d", 4)))
    assert _found(BucketTable(spark, path)) == [(1, "c", 3), (2, "b", 2)]


def test_empty_tables_null_keys_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, _row int, _key string, bucket int, version long")
    table = BucketTable.create(empty, str(tmp_path / "t"), "k", 4)
    assert table.read().collect() == [] and table.read().schema == empty.schema
    table = table.upsert(spark.createDataFrame([("x", 1, "a", 2, 3), ("x", 1, "a", 2, 3), ("", 4, "b", 5, 6)], empty.schema))
    assert sorted(map(tuple, table.read().collect())) == [("", 4, "b", 5, 6), ("x", 1, "a", 2, 3)]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, 1, "a", 2, 3)], empty.schema))
    with pytest.raises(ValueError):
        BucketTable.create(empty, table.path, "k")


def test_soft_deletion_keeps_the_first_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, None)], "k long, deleted_at timestamp")
    table = BucketTable.create(rows, str(tmp_path / "t"), "k", 4)
    keys = spark.createDataFrame([(1,), (1,), (7,)], "k long")
    table = table.delete(keys, AT).delete(keys, AT + dt.timedelta(days=1))
    assert sorted(map(tuple, table.read().collect())) == [(1, AT), (2, None)]


def test_a_stream_that_begins_again_counts_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    events = lambda rows: spark.createDataFrame(rows, "user_id long, n long")
    BucketTable.create(events([]), path, "user_id", 4)
    add = lambda table, df, batch: table.merge(df.groupBy("user_id").agg(F.sum("n").alias("n")), lambda old, new: old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n")), batch)
    for i in range(2):
        events([(1, 1), (2, 10 * (i + 1))]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id long, n long").parquet(source)
        ingest.process(stream, stream_into(path, add), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(map(tuple, BucketTable(spark, path).read().collect())) == [(1, 2), (2, 30)]
    # a new checkpoint: the rows are handed over again, from batch 0 on
    ingest.process(spark.readStream.schema("user_id long, n long").parquet(source), stream_into(path, add), str(tmp_path / "fresh")).awaitTermination()
    assert sorted(map(tuple, BucketTable(spark, path).read().collect())) == [(1, 2), (2, 30)]


def test_of_several_source_rows_one_counts(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1), (2, "z", 1)], "k long, v string, at int")
    assert sorted(map(tuple, sinks.merge_upsert(target, source, "k", order="at").collect())) == [(1, "y"), (2, "z")]
