"""Queries whose searches have every user as a query."""

import numpy as np

from tidemark.operators import hierarchy, similarity
from tidemark.plans import views
from tidemark.plans.catalog import QUERIES


def test_reasons_for_all_users(spark, sf_dir):
    users = {r.user_id for r in views.bets(spark, sf_dir).select("user_id").distinct().collect()}
    assert {r.user_id_1 for r in QUERIES["similarity_reasons"](spark, sf_dir).collect()} == users


def test_knn_of_all_rows_in_few_parts(spark):
    """More blocks of queries than parts of rows, copies among them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[200:] = x[:100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -9)
    expected = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -score[i]))[:7]}
    for most in (500_000, 70):
        assert {(r.query_id, r.vec_id) for r in similarity.knn(rows, rows, 7, block=20, most=most).collect()} == expected


def test_cosine_neighbours_by_leaves(spark):
    """Copies, near copies whose cosines are equal to nine places, opposite vectors and vectors without a direction."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4))
    x[300:360], x[360:400] = x[:60] * 3, x[:1]
    x[400:500] = x[100:200] + rng.normal(size=(100, 4)) * 1e-6
    x[500:530] = -x[:30]
    ids = rng.permutation(600)
    vectors = {int(i): v.tolist() for i, v in zip(ids, x)} | {600: None, 601: [0.0] * 4, 602: [1.0, None, 0.0, 0.0], -5: [float("nan")] * 4}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    plain = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score is None, round(r.score or 0, 8)) for r in df.collect())
    expected = plain(similarity.knn(rows, rows, 5))
    assert len(expected) == 5 * len(vectors)
    found = hierarchy.cosine_neighbours(rows, 5, leaf_size=32, few=0)
    assert plain(found) == expected
    few = rows.where("vec_id >= 600 or vec_id < 3")
    assert plain(hierarchy.cosine_neighbours(few, 5, few=0)) == plain(similarity.knn(few, few, 5))


def test_hybrids_meet_similar_users_of_all(spark, sf_dir):
    users = {r.id for r in views.users(spark, sf_dir).select("id").collect()}
    for name in ("recommend_hybrid", "recommend_hybrid_learned"):
        assert {r.user_id for r in QUERIES[name](spark, sf_dir).where("sources like '%similar%'").collect()} == users
