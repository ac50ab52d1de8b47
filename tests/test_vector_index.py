"""The stored index: recall, changes, filters, and profiles through it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import similarity
from tidemark.operators.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(n, d=12, groups=9, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 2
    return [(i, [float(x) for x in centres[i % groups] + rng.normal(size=d)], i % groups) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return _vectors(900) + [(2000 + i, _vectors(1)[0][1], 0) for i in range(300)]  # a quarter are one vector


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    bad = [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [float("nan")] * 12, 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    return VectorIndex.build(df, str(tmp_path_factory.mktemp("index")), cells=16, buckets=8)


def test_search_finds_nearly_all_neighbours(spark, rows, index):
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.where("vec_id % 20 = 0")
    probes = index.probes_for(10, 0.95, 40)
    found = index.search(queries, 10, probes)
    exact = similarity.knn(queries, df, 10)
    assert found.groupBy("query_id").count().agg(F.min("count"), F.max("count")).first() == (10, 10)
    # equal scores are as good as each other
    worst = {r.query_id: r.s for r in exact.groupBy("query_id").agg(F.min("score").alias("s")).collect()}
    rows_found = found.collect()
    assert sum(r.score >= worst[r.query_id] for r in rows_found) / len(rows_found) >= 0.9
    assert probes < len(index.centres) and index.recall(10, len(index.centres), 40) >= 0.98
    best = {(r.query_id, r.rank): r.score for r in exact.collect()}
    assert all(r.score <= best[r.query_id, r["rank"]] + 1e-9 and r.query_id != r.vec_id for r in rows_found)
    assert {r.vec_id for r in rows_found}.isdisjoint({5000, 5001, 5002})


def test_changes_are_seen_at_once_and_after_opening_again(spark, rows, tmp_path):
    df = spark.createDataFrame(rows[:400], SCHEMA)
    index = VectorIndex.build(df, str(tmp_path / "i"), cells=6, buckets=8)
    asked = df.where("vec_id = 7")
    every = len(index.centres)
    index.upsert(spark.createDataFrame([(9000, rows[7][1], 3), (8, rows[7][1], 4)], SCHEMA), batch=0)
    assert [r.vec_id for r in index.search(asked, 2, every).orderBy("rank").collect()] == [8, 9000]
    index.upsert(spark.createDataFrame([(9001, rows[7][1], 3)], SCHEMA), batch=0)  # handed over again: nothing
    index.delete(spark.createDataFrame([(8,)], "vec_id long"))
    again = VectorIndex(spark, str(tmp_path / "i"))
    first = again.search(asked, 2, every).orderBy("rank").collect()
    assert first[0].vec_id == 9000 and first[0].score == 1.0 and first[1].score < 1.0
    assert again.table.read().count() == 400 and again.cells().agg(F.sum("vectors")).first()[0] == 400
    some = again.search(asked, 3, every, where="label = 5").collect()
    assert {rows[r.vec_id][2] for r in some} == {5} and len(some) == 3
    assert again.search(asked.limit(0), 3, 2).collect() == []


def test_profiles_are_searched_through_an_index(spark, tmp_path):
    rng = random.Random(3)
    names = ["session_frequency", "game_diversity", "win_rate", "risk_tolerance", "session_duration", "avg_bet", "lifetime_value", "total_deposits"]
    rows = [(i, *[rng.random() * 10 for _ in names], [f"g{rng.randrange(5)}"]) for i in range(120)]
    profiles = spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{n} double" for n in names) + ", favorite_games array<string>")
    vectors = similarity.profile_vectors(profiles)
    index = VectorIndex.build(vectors.withColumnRenamed("user_id", "vec_id"), str(tmp_path / "i"), cells=4, buckets=4)
    queries = profiles.where("user_id % 10 = 0")
    key = lambda df: sorted((r.user_id_1, r.user_id_2, r["rank"]) for r in df.collect())
    assert key(similarity.similar_users(profiles, vectors, queries, 5, lambda q, k: index.search(q, k, 4, rerank=120))) == key(similarity.similar_users(profiles, vectors, queries, 5))
