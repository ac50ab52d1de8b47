"""Steps whose work must grow no faster than their input."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators import evaluation, hierarchy, monitoring
from tidemark.sources.buckets import BucketTable


def test_too_few_rows_have_no_core(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0])], "id long, features array<double>")
    assert {r.id: (r.label, r.is_core) for r in hierarchy.dbscan(df, "id", "features", 0.3, 4, 2).collect()} == {1: (-1, False), 2: (-1, False)}


def test_components_in_one_array_or_by_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 41), (41, 60)], "a long, b long")
    expected = {i: i // 10 for i in range(40)} | dict.fromkeys((50, 41, 60), 4)
    for most in (1 << 20, 5):
        found = {r.id: r.root for r in hierarchy.components(edges, most).collect()}
        assert set(found) == set(expected) and len({(expected[i], found[i]) for i in found}) == 5


def test_nearest_core_in_a_dense_place_makes_no_pairs_of_rows(spark):
    rng = np.random.default_rng(1)
    known, new = rng.normal(0, 0.3, (300, 2)), np.concatenate([rng.normal(0, 0.4, (90, 2)), [[9.0, 9.0]]])
    frame = lambda x, name: spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], f"{name} long, features array<double>")
    made = evaluation.dbscan_predict(frame(new, "id"), frame(known, "label"), "id", "features", 0.2, 2, leaf_size=40)
    assert "cell" not in made._jdf.queryExecution().optimizedPlan().toString()
    d = np.sqrt(((new[:, None] - known[None]) ** 2).sum(axis=2))
    expected = {i: int(d[i].argmin()) if d[i].min() <= 0.3 else -1 for i in range(len(new))}
    assert {r.id: r.label for r in made.collect()} == expected


def test_kth_distances_of_more_rows_than_a_block(spark):
    x = np.random.default_rng(2).normal(size=(1300, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, features array<double>").coalesce(1)
    found = {r.id: r.distance for r in evaluation.kth_distances(df, "id", k=3, sample=50).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    assert len(found) == 50 and all(abs(v - d[i, 3]) < 1e-6 for i, v in found.items())


def test_lineage_doubles_its_steps(spark, monkeypatch):
    rounds = []
    real = monitoring.written
    monkeypatch.setattr(monitoring, "written", lambda df, what: rounds.append(what) or real(df, what))
    chain = [(f"f{i}", f"f{i - 1}") for i in range(1, 21)] + [("f3", "f0"), ("a", "b"), ("b", "a")]
    found = {r.feature: (r.dependents, r.depth) for r in monitoring.lineage(spark.createDataFrame(chain, "feature string, depends_on string")).collect()}
    assert found == {f"f{i}": (20 - i, 20 - i if i else 18) for i in range(20)} | {"a": (2, 2), "b": (2, 2)}
    assert len(rounds) <= 7


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(BucketTable, "rows_per_task", 100, raising=False)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    table = BucketTable.create(rows, str(tmp_path / "t"), "k", 2)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")]
    assert table.read().count() == 2000 and max(sizes) < 500
    table = table.upsert(rows.where("k < 100").withColumn("v", F.lit("y")))
    assert table.read().where("v = 'y'").count() == 100 and table.read().select("k").distinct().count() == 2000


def test_a_far_row_makes_its_leaf_ask_alone(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.3, (600, 2)), [[40.0, 40.0]]])
    nodes, n, leaves = hierarchy.leaves_of(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "key long, x array<double>"), 20), len(x), 31
    where = hierarchy._directory(nodes.withColumn("core", F.lit(0.0)), 2, True)
    asked = lambda df: df.agg(F.sum(F.size("ask_ids"))).first()[0]
    assert n <= asked(hierarchy.core_asks(hierarchy._leaves(nodes, "x", "w"), where, 2, 3)) < n * leaves / 3
    most = nodes.select("leaf", "id", "x", F.lit(0.0).alias("core"), F.col("id").alias("comp"), F.when(F.col("id") == n - 1, 100.0).otherwise(0.02).alias("most"))
    assert leaves - 1 <= asked(hierarchy.edge_asks(hierarchy._leaves(most, "x", "core", "comp", "most"), where, np.full(leaves, -1), 2)) < 4 * n
