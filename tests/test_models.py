"""Models, choices and streams against brute force and known values."""

import collections
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import extend, order, significance
from tidemark.operators import alerts, clustering, evaluation, quality, similarity
from tidemark.sources import sinks
from tidemark.streaming import ingest


def test_p_values(spark):
    """t with 1 and 2 degrees and F with 2 have closed forms."""
    rows = spark.createDataFrame([(float(t), float(f)) for t, f in ((0.3, 0.2), (-1.7, 1.0), (4.0, 9.5), (0.0, 0.0))], "t double, f double")
    for r in rows.select("t", "f", significance.p_value_t(F.col("t"), F.lit(1)).alias("a"), significance.p_value_t(F.col("t"), F.lit(2)).alias("b"), significance.p_value_f(F.col("f"), F.lit(2), F.lit(7)).alias("c")).collect():
        assert r.a == pytest.approx(1 - 2 / math.pi * math.atan(abs(r.t)), abs=1e-12)
        assert r.b == pytest.approx(1 - abs(r.t) / math.sqrt(2 + r.t**2), abs=1e-12)
        assert r.c == pytest.approx((1 + 2 * r.f / 7) ** (-3.5), abs=1e-12)
    one = spark.range(1).select(significance.p_value_r(F.lit(1.0), F.lit(5)).alias("exact"), significance.p_value_r(F.lit(0.5), F.lit(2)).alias("few"), significance.p_value_t(F.lit(None).cast("double"), F.lit(3)).alias("none")).first()
    assert one.exact == 0 and one.few is None and one.none is None


def _greedy(rows, budget):
    out, used = [], set()
    for u, c, roi, cost in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if cost <= budget and u not in used:
            out.append((u, c))
            used.add(u)
            budget -= cost
    return sorted(out)


@pytest.mark.parametrize("budget", [0.0, 7.5, 60.0, 300.0, 10_000.0])
@pytest.mark.parametrize("tied", [False, True])
def test_portfolio_is_greedy(spark, budget, tied):
    rng = np.random.default_rng(int(budget) + tied)
    rows = [(u, c, 1.0 if tied else float(rng.integers(1, 60)) / 10, float((c + 1) * 2.5)) for u in range(60) for c in range(4) if rng.random() < 0.7]
    found = similarity.portfolio(spark.createDataFrame(rows, "user_id long, campaign_id long, roi double, cost double"), budget, ranges=5)
    assert sorted((r.user_id, r.campaign_id) for r in found.collect()) == _greedy(rows, budget)


def test_rules_in_blocks(spark):
    rng = np.random.default_rng(4)
    users = spark.createDataFrame([(i, float(rng.random()), float(rng.integers(1, 90)), ["a"] if i % 2 else None, float(rng.integers(0, 40))) for i in range(9)], "user_id long, risk_tolerance double, avg_bet double, game_categories array<string>, session_duration double")
    games = spark.createDataFrame([(i, 0.9 + i / 500, ("low", "medium", "high")[i % 3], float(i), float(3 * i), "ab"[i % 2], float(i % 50)) for i in range(70)], "game_id long, rtp double, volatility string, min_bet double, max_bet double, category string, avg_session_duration double")
    whole, parts = (collections.Counter(similarity.recommend_rules(users, games, 5, block).collect()) for block in (1000, 9))
    assert whole == parts and whole.total() == 45


def test_outcome_models(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(rng.random()), int(x > 50), int(x < 20), float(x * 10), float(x / 100)) for i, x in enumerate(rng.integers(0, 100, 300))]
    df = spark.createDataFrame(rows, "user_id long, avg_bet double, win_rate double, converted int, churned int, ltv double, engaged double")
    out = similarity.predict_outcomes(similarity.fit_outcomes(df, trees=5, forest_depth=4, boosted_depth=3), df).collect()
    assert all(0 <= r.conversion <= 1 and 0 <= r.churn_risk <= 1 and 0 <= r.engagement <= 1 for r in out)
    assert np.corrcoef([r.ltv for r in out], [r.predicted_ltv for r in out])[0, 1] > 0.95
    assert np.mean([(r.conversion > 0.5) == bool(r.converted) for r in out]) > 0.95


def test_profiles_with_missing_columns(spark):
    df = spark.createDataFrame([(1, 120.0, ["slots"], ["z", "b"]), (2, None, None, None), (3, 60.0, ["poker"], [])], "user_id long, avg_bet double, game_categories array<string>, favorite_games array<string>")
    rows = {r.user_id: r.embedding for r in similarity.profile_vectors(df, text_dimensions=16).collect()}
    assert {len(v) for v in rows.values()} == {16 + 14 + 31 + 16} and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in rows.values())
    text = {r.user_id: r.description for r in similarity.profile_text(df).collect()}
    assert text[1].startswith("Gaming profile: high roller, occasional player, unlucky player, prefers z, b,") and "prefers" not in text[2]


def test_similar_users_are_those_of_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    cols = ["session_frequency", "game_diversity", "win_rate", "risk_tolerance", "session_duration", "avg_bet", "lifetime_value", "total_deposits"]
    df = spark.createDataFrame([(i, *map(float, rng.random(8)), ["a"]) for i in range(40)], "user_id long, " + ", ".join(f"{c} double" for c in cols) + ", favorite_games array<string>")
    found = similarity.similar_users(df, similarity.profile_vectors(df), df.where("user_id < 2"), 3)
    assert found.groupBy("user_id_1").count().where("count <> 3").count() == 0 and found.where("user_id_1 = user_id_2").count() == 0


def test_collaborative_filtering_covers_all_users(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(u, g, float(5 if u % 2 == g % 2 else 1)) for u in range(20) for g in rng.choice(12, 6, replace=False).tolist()], "user_id long, game_id long, rating double")
    found = similarity.recommend_cf(rows, 3)
    assert found.groupBy("user_id").count().where("count = 3").count() == 20
    right = found.where("user_id % 2 = game_id % 2").count()
    assert right >= 0.8 * found.count()


def test_anomalies_are_isolated(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(400)] + [(1000 + i, 9.0 + i, -9.0 - i) for i in range(8)] + [(2000, None, 1.0)]
    found = {r.id: r for r in evaluation.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=30, contamination=0.05).collect()}
    assert len(found) == 408 and all(found[1000 + i].is_anomaly for i in range(8)) and found[1007].severity == "medium"
    assert sum(r.is_anomaly for r in found.values()) <= 30
    assert evaluation.isolation_forest(spark.createDataFrame(rows[:5], "id long, a double, b double"), "id", ["a", "b"]).count() == 0


def test_prediction_by_nearest_core(spark):
    cores = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 5.0], 2), ([0.5, 0.0], 7)], "features array<double>, label long")
    points = spark.createDataFrame([(1, [0.1, 0.1]), (2, [5.9, 5.9]), (3, [9.0, 9.0]), (4, [0.25, 0.0]), (5, [-1.4, 0.0])], "id long, features array<double>")
    found = {r.id: r.label for r in evaluation.dbscan_predict(points, cores, "id", "features", 1.0, 2).collect()}
    assert found == {1: 1, 2: 2, 3: -1, 4: 1, 5: 1}


def test_measures_of_clear_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=2) * 0.1 + 10 * (i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    assert all(r.silhouette > 0.9 and r.n == 30 for r in evaluation.silhouette(df, "id").collect())
    assert evaluation.adjusted_mutual_information(df.withColumn("b", F.col("label") + 1), "label", "b").first().ami == pytest.approx(1)
    assert abs(evaluation.adjusted_mutual_information(df.withColumn("b", F.col("id") % 2), "label", "b").first().ami) < 0.1
    k, labelled = evaluation.kmeans_large(df.drop("label"), range(2, 6))
    assert k == 3 and labelled.select("label").distinct().count() == 3
    assert evaluation.bootstrap_stability(df.drop("label"), 3, 2).where("level = 'stable'").count() == 2
    d = {r.id: r.distance for r in evaluation.kth_distances(df, "id", k=4, sample=10).collect()}
    x = np.array([r[2] for r in rows])
    assert len(d) == 10 and all(v == pytest.approx(np.sort(np.linalg.norm(x - x[i], axis=1))[4]) for i, v in d.items())
    assert 0 < evaluation.dbscan_eps(df, "id") < 10
    assert clustering.internal_metrics(df).first().clusters == 3


def test_spectral_consensus_keeps_clear_groups(spark):
    rows = [(i, i // 20, (i // 20 + 1) % 3, i // 20 if i % 10 else 2 - i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int")
    found = {r.id: r.label for r in evaluation.ensemble_spectral(df, "id", ["a", "b", "c"], [1.0, 1.0, 1.0]).collect()}
    assert len({(found[i], i // 20) for i in range(60) if i % 10}) == 3


def test_places_in_the_whole_order(spark):
    df = spark.range(997).select(((F.col("id") * 577) % 997).alias("k"))
    assert all(r.k == r.place for r in order.numbered(df, F.col("k"), ranges=7).collect())


def test_quantiles_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x, y = np.where(rng.random(1500) < 0.4, 3.0, rng.normal(size=1500)), rng.integers(0, 5, 1500).astype(float)
    df = spark.createDataFrame([(float(a), None if i % 7 == 0 else float(b), None) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, z double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = order.exact_quantiles(df, {"x": qs, "y": qs, "z": [0.5]}, ranges=6)
    assert found["x"] == pytest.approx(np.quantile(x, qs).tolist()) and found["y"] == pytest.approx(np.quantile(y[np.arange(1500) % 7 != 0], qs).tolist()) and found["z"] == [None]
    assert order.exact_quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}
    assert order.modes(df.limit(0), ["x"]) == {"x": None} and order.modes(df, ["x"]) == {"x": 3.0}


def test_alerts_need_consecutive_days(spark):
    day = dt.date(2024, 1, 1)
    rates = [0.01, 0.2, 0.01, 0.2, 0.2, 0.2]
    metrics = spark.createDataFrame([("failure_rate", day + dt.timedelta(days=i), r) for i, r in enumerate(rates)] + [("volume", day + dt.timedelta(days=i), 100.0 if i < 5 else 350.0) for i in range(6)], "metric string, day date, value double")
    found = sorted((r.rule, r.day.day) for r in alerts.business_alerts(metrics).collect())
    assert found == [("transaction_failures", 5), ("transaction_failures", 6), ("volume_spike", 6)]
    assert alerts.drift_summary(spark.createDataFrame([], "detected_at timestamp, severity string, drift_score double, affected_features array<string>"), F.lit(dt.datetime(2024, 1, 1))).first().total_alerts == 0


def test_alerts_of_many_equal_times(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(minutes=i // 100), 0.1) for i in range(4000)] + [("b", at, 0.8)]
    found = sorted((r.dimension, r.ts.minute) for r in quality.quality_alerts(spark.createDataFrame(rows, "dimension string, ts timestamp, score double")).collect())
    assert found == [("a", 0), ("a", 15), ("a", 30), ("b", 0)]


def test_online_centres_find_groups(spark):
    rng = np.random.default_rng(7)
    model = ingest.OnlineKMeans(2, ["x", "y"], per_version=2)
    for i in range(6):
        model.learn(spark.createDataFrame([(float(rng.normal() + 20 * (k % 2)), float(rng.normal() - 20 * (k % 2))) for k in range(60)], "x double, y double"), i)
    model.learn(spark.createDataFrame([], "x double, y double"))
    assert model.version == 3 and model.n == 360 and model.mean[0] == pytest.approx(10, abs=0.5)
    found = [r.label for r in model.predict(spark.createDataFrame([(0.0, 0.0), (20.0, -20.0), (1.0, -1.0)], "x double, y double")).collect()]
    assert found[0] == found[2] != found[1]


def test_snapshots(spark, tmp_path):
    df, folder = spark.range(3).select(F.col("id").alias("k")), str(tmp_path / "snaps")
    with pytest.raises(ValueError):
        sinks.restore_latest(df, folder)
    for day in (1, 20, 28):
        sinks.snapshot_table(df.withColumn("k", F.col("k") + day), folder, dt.datetime(2024, 1, day))
    assert len(sinks.expire_snapshots(df, folder, dt.datetime(2024, 2, 15))) == 1
    assert sorted(r.k for r in sinks.restore_latest(df, folder).collect()) == [28, 29, 30]
    assert len(sinks.expire_snapshots(df, folder, dt.datetime(2030, 1, 1))) == 1 and len(sinks.snapshots(df, folder)) == 1


def test_feature_registry_orders_and_refuses(spark):
    f = extend.FeatureRegistry()
    f.register("c", F.col("b") * 2, ("b",))
    f.register("b", F.col("id") + 1, ("id",))
    assert [r.c for r in f.compute(spark.range(2), ["c"]).collect()] == [2, 4]
    f.register("d", F.col("e"), ("e",))
    f.register("e", F.col("d"), ("d",))
    for names, error in ((["d"], "circle"), (["nothing"], "unknown")):
        with pytest.raises(ValueError, match=error):
            f.compute(spark.range(1), names)


def test_service_rules(spark):
    from datetime import datetime as at

    requests = spark.createDataFrame([(at(2024, 1, 1, 0, 5), 1.0, 200, False), (at(2024, 1, 1, 0, 6), 3.0, 500, None), (at(2024, 1, 1, 2, 0), None, None, True), (at(2024, 1, 1, 2, 9), 0.5, 401, True), (None, 9.0, 500, True)], "ts timestamp, s double, code int, login boolean")
    found = {(r.metric, r["at"].hour): r.value for r in alerts.request_metrics(requests, "ts", "s", "code", "login").collect()}
    assert found == pytest.approx({("latency_p99", 0): 2.98, ("availability", 0): 0.5, ("throughput", 0): 2 / 3600, ("failed_logins", 0): 0, ("throughput", 1): 0, ("failed_logins", 1): 0,
                                   ("latency_p99", 2): 0.5, ("availability", 2): 0.5, ("throughput", 2): 2 / 3600, ("failed_logins", 2): 1 / 3600})
    cases = spark.createDataFrame([(at(2024, 1, 1, 0), at(2024, 1, 1, 2)), (at(2024, 1, 1, 0), None), (None, at(2024, 1, 1, 1)), (at(2024, 1, 1, 3), at(2024, 1, 1, 3))], "a timestamp, b timestamp")
    assert [r.value for r in alerts.pending_metrics(cases, "a", "b").orderBy("at").collect()] == [2, 2, 1, 1]
    stale = alerts.staleness_metrics(cases.where("a is not null"), "a", until=F.lit(dt.datetime(2024, 1, 2, 5))).orderBy("at").collect()
    assert [r.value for r in stale][:5] == [1, 2, 3, 1, 2] and len(stale) == 30 and stale[-1].value == 27
    sends = alerts.send_metrics(cases, "a", "b is not null", "b is null")
    assert sorted((r.metric, r["at"].hour, r.value) for r in sends.collect()) == [("delivery_failure_rate", 0, 0.5), ("delivery_failure_rate", 3, 0.0), ("engagement_rate", 0, 0.5), ("engagement_rate", 3, 1.0)]
    every = stale and alerts.business_alerts(alerts.staleness_metrics(cases, "a", until=F.lit(dt.datetime(2024, 1, 2, 5))), alerts.SERVICE_RULES, "at")
    assert [(r.rule, r.value) for r in every.orderBy("at").collect()] == [("stale_pipeline", float(x)) for x in (25, 26, 27)]
    for f in (lambda d: alerts.request_metrics(d, "a", "1", "200", "true"), lambda d: alerts.pending_metrics(d, "a", "b"), lambda d: alerts.staleness_metrics(d, "a", until=F.lit(dt.datetime(2024, 1, 1)))):
        assert f(cases.where("false")).count() == 0
