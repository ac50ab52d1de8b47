"""Fixed cases of operators, and properties of those that SQL can't express."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import cleaning, clustering, evaluation, hierarchy, profiles, quality, segments, similarity
from tidemark.sources import files, sinks
from tidemark.streaming import ingest

AT = dt.datetime(2024, 6, 1)
DAY = dt.timedelta(days=1)


def _user(spark, **change):
    base = {"id": 1, "name": "a", "segment": "x", "cluster_id": 1, "registration_date": AT - 100 * DAY, "last_activity": AT - 5 * DAY, "total_deposits": 1000.0, "total_withdrawals": 200.0, "total_bets": 2000.0, "bet_count": 100, "win_rate": 60.0} | change
    return spark.createDataFrame([tuple(base.values())], "id long, name string, segment string, cluster_id long, registration_date timestamp, last_activity timestamp, total_deposits double, total_withdrawals double, total_bets double, bet_count long, win_rate double")


def test_segment_features(spark):
    r = segments.segment_features(_user(spark), AT).first()
    assert (r.ltv, r.bet_frequency, r.avg_bet_size, r.days_since_last_activity, r.registration_days) == (800, 1, 20, 5, 100)
    assert 0 <= r.churn_risk <= 1
    r = segments.segment_features(_user(spark, last_activity=None), AT).first()
    assert (r.days_since_last_activity, r.activity_score) == (999, 0)


@pytest.mark.parametrize(("days", "frequency", "ltv", "win", "high"), [(1, 5.0, 1000.0, 70.0, False), (30, 0.1, 10.0, 20.0, True)])
def test_churn_risk(spark, days, frequency, ltv, win, high):
    row = spark.range(1).select(*[segments.churn_risk(F.lit(days), F.lit(frequency), F.lit(ltv), F.lit(win), m).alias(m) for m in ("corrected", "as_written")]).first()
    assert (row.corrected > 0.5) == high
    assert row.as_written <= 0.4


@pytest.mark.parametrize(("change", "segment", "confidence"), [
    ({"total_deposits": 2000.0, "ltv": 3000.0, "bet_frequency": 10.0, "registration_days": 200, "days_since_last_activity": 1, "activity_score": 95.0, "churn_risk": 0.1}, "high_value", 0.95),
    ({"days_since_last_activity": 45, "activity_score": 10.0}, "inactive", 0.9),
    ({"registration_days": 10, "total_deposits": 50.0}, "new_user", 0.85),
    ({}, "low_value", 0.7)])
def test_rule_segment(spark, change, segment, confidence):
    base = {"total_deposits": 500.0, "ltv": 100.0, "bet_frequency": 1.0, "registration_days": 100, "days_since_last_activity": 3, "activity_score": 90.0, "churn_risk": 0.5} | change
    r = segments.rule_segment(spark.createDataFrame([tuple(base.values())], "total_deposits double, ltv double, bet_frequency double, registration_days long, days_since_last_activity long, activity_score double, churn_risk double")).first()
    assert (r.segment, r.confidence) == (segment, confidence)


def test_segment_percentages(spark):
    parts = {"high_value": 50, "medium_value": 200, "low_value": 400, "new_user": 250, "inactive": 100}
    rows = spark.createDataFrame([(s, 1.0) for s, n in parts.items() for _ in range(n)], "segment string, ltv double")
    r = segments.segment_statistics(rows).first()
    assert [round(r[f"{s}_percentage"]) for s in parts] == [5, 20, 40, 25, 10]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Já!  está (ok) ", "R$"), (None, " euro"), ("a@b.co", "chf")], "a string, b string")
    found = rows.select(text.standardize(F.col("a")).alias("a"), text.currency(F.col("b")).alias("b"), text.valid_email(F.col("a")).alias("c")).collect()
    assert [tuple(r) for r in found] == [("Já está ok", "BRL", False), (None, "EUR", False), ("a@b.co", "CHF", True)]


def test_cleaner_fixture(spark):
    rows = spark.createDataFrame([(1, "u1", 10.0, AT), (1, "u1", 10.0, AT), (2, "u2", -5.0, AT), (3, "u3", 5e5, AT), (4, None, 7.0, AT), (5, "u5", 12.0, None)], "transaction_id long, user_id string, amount double, created_at timestamp")
    kept, report = cleaning.clean(rows, AT)
    assert {r.user_id for r in kept.collect()} == {"u1", "u5"}
    assert {r.step: r.removed for r in report.collect()}["exact_duplicates"] == 1
    with pytest.raises(ValueError):
        cleaning.require_key(rows, "nothing")
    assert cleaning.clean(rows.limit(0), AT)[0].count() == 0


def test_profile_edges(spark):
    schema = "event_id long, user_id long, timestamp timestamp, bet_amount double, win_amount double"
    rows = spark.createDataFrame([(1, 1, AT, 5.0, None), (2, 2, AT, 5.0, 0.0), (3, 2, AT, 5.0, 9.0), (4, 3, AT, None, 1.0)], schema)
    risk = {r.user_id: r for r in profiles.risk_profile(rows).collect()}
    assert (risk[1].bet_volatility, risk[1].bet_p95_ratio, risk[1].risk_consistency) == (0, 1, 1)
    assert risk[2].bet_volatility == 0 and 3 not in risk
    assert {r.user_id: r.spending_concentration for r in profiles.spending_concentration(rows).collect()} == {1: 1.0, 2: 1.0}
    assert {r.user_id: (r.max_winning_streak, r.max_losing_streak) for r in profiles.streaks(rows).collect()} == {1: (0, 1), 2: (1, 1)}


def test_alert_cooldown(spark):
    rows = spark.createDataFrame([("d", AT + dt.timedelta(minutes=m), 0.1) for m in (0, 5, 14, 15, 29, 31)], "dimension string, ts timestamp, score double")
    found = sorted(r.ts for r in quality.quality_alerts(rows).collect())
    assert found == [AT + dt.timedelta(minutes=m) for m in (0, 15, 31)]


def _blobs(spark, seed=42):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    rows = [(i, [float(x) for x in p], i // 40) for i, p in enumerate(points)] + [(1000 + i, [50.0 + 10 * i, -50.0], -1) for i in range(5)]
    return spark.createDataFrame(rows, "id long, features array<double>, truth int")


def test_kmeans_and_k(spark):
    rows = _blobs(spark).where("truth >= 0")
    _, labelled = clustering.kmeans(rows, 3)
    assert clustering.external_metrics(labelled, "label", "truth").first().ari == pytest.approx(1)
    k, table = clustering.kmeans_auto(rows, range(2, 6))
    assert k == 3 and table.count() == 4


def test_dbscan_against_brute_force(spark):
    rows = _blobs(spark)
    found = {r.id: (r.label, r.is_core) for r in hierarchy.dbscan(rows, "id", "features", 0.3, 4, 2).collect()}
    ids, x = zip(*[(r.id, r.features) for r in rows.collect()], strict=True)
    x = np.array(x)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.3**2
    core = near.sum(1) >= 4
    label = {i: i for i, c in zip(ids, core, strict=True) if c}
    for _ in ids:
        for a in np.flatnonzero(core):
            label[ids[a]] = min(label[ids[b]] for b in np.flatnonzero(near[a] & core))
    for a, i in enumerate(ids):
        if core[a]:
            assert found[i] == (label[i], True)
        else:
            around = {label[ids[b]] for b in np.flatnonzero(near[a] & core)}
            assert found[i][1] is False and (found[i][0] in around if around else found[i][0] == -1)


def test_matrix_needs_rows(spark):
    with pytest.raises(ValueError):
        clustering.prepare_matrix(spark.createDataFrame([(1, 2.0)], "id long, a double"), "id", ["a"])


def test_knn_limit(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(4)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        similarity.knn(rows, rows, 1, limit=2)


def test_knn_of_many_queries(spark):
    rows = spark.range(10_001).selectExpr("id as vec_id", "array(cast(1 as float), cast(id % 97 as float)) as embedding", "0 as label")
    few = rows.where("vec_id < 4")
    assert similarity.knn(rows, few, 1).count() == 10_001
    one, more = (similarity.knn(rows.where("vec_id < 200"), rows.where("vec_id < 300"), 3, block=n) for n in (1000, 30))
    assert sorted(one.collect()) == sorted(more.collect()) and one.count() == 600


def test_feather_and_json(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"a": [1, 2], "b": ["x", None]}), str(tmp_path / "t.feather"), compression="uncompressed")
    assert files.read_files(spark, str(tmp_path / "t.feather"), "feather", "a long, b string").count() == 2
    (tmp_path / "d.json").write_text('[{"u": {"id": 1, "deep": {"x": 2}}}]')
    assert sorted(files.read_files(spark, str(tmp_path / "d.json"), "json").columns) == ["u.deep.x", "u.id"]
    with pytest.raises(ValueError):
        files.read_files(spark, "x", "avro")


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    source = spark.createDataFrame([(2, "b"), (3, None)], "k long, v string")
    once = sinks.merge_upsert(target, source, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.merge_upsert(once, source, "k").collect())) == [(1, "a"), (2, "b"), (3, None)]


def test_progress_rows(spark):
    rows = ingest.stream_metrics([{"batchId": 1, "numInputRows": 5, "stateOperators": [{"numRowsDroppedByWatermark": 2}]}], spark)
    assert tuple(rows.first()) == (1, 5, 0.0, 2)


def test_lag_by_topic_and_partition():
    sources = [
        {"endOffset": {"bets": {"0": 5, "1": 7}}, "latestOffset": {"bets": {"0": 9, "1": 7, "2": 4}}}, {"endOffset": '{"wins": {"0": 1}}', "latestOffset": '{"wins": {"0": 3}}'},
        {"endOffset": {"logOffset": 2}, "latestOffset": None}, {"endOffset": "text", "latestOffset": "text"}]
    assert ingest.lags({"sources": sources}) == {"bets:0": 4, "bets:1": 0, "bets:2": 4, "wins:0": 2}
    assert ingest.lags({}) == {}


def test_progress_log_of_a_repeated_batch(spark, tmp_path):
    """A batch that is told of again replaces its row; idle progress leaves none."""
    import json
    from types import SimpleNamespace

    log = ingest.ProgressLog(spark, str(tmp_path / "log"))
    for batch, n in ((0, 5), (1, 7), (1, 7), (2, 0)):
        told = {"id": "a", "batchId": batch, "numInputRows": n, "timestamp": "2024-01-02T03:04:05.000Z", "durationMs": {"triggerExecution": 1500}, "stateOperators": [{"numRowsDroppedByWatermark": batch}],
                "sources": [{"endOffset": {"t": {"0": n}}, "latestOffset": {"t": {"0": 10}}}]}
        log.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json=json.dumps(told))))
    assert [(r.query, r.batch, r.rows, r.seconds, r.dropped, r.lag) for r in log.rows().orderBy("batch").collect()] == [("a", 0, 5, 1.5, 0, {"t:0": 5}), ("a", 1, 7, 1.5, 1, {"t:0": 3})]


def test_hybrid_of_four_recommenders(spark):
    parts = {"collaborative": [(1, 1, 1.0), (1, 2, 0.5)], "content": [(1, 1, 0.4)], "similar": [(2, 1, 1.0)], "popular": [(1, 2, 1.0), (2, 1, 0.5)]}
    frames = {k: spark.createDataFrame(rows, "user_id long, game_id long, score double") for k, rows in parts.items()}
    found = {(r.user_id, r.game_id): (round(r.score, 9), r.sources) for r in similarity.recommend_hybrid(frames).collect()}
    assert found == {(1, 1): (0.52, "collaborative,content"), (1, 2): (0.3, "collaborative,popular"), (2, 1): (0.25, "popular,similar")}


def test_targeting_details_of_nulls(spark):
    schema = "conversion double, churn_risk double, predicted_ltv double, engagement double, inactive_days int, bonus_usage double, segment string, target_segments array<string>"
    rows = spark.createDataFrame([(0.34375, 0.1, 2000.0, 0.6, 3, 0.5, "vip", ["vip"]), (0.05, 0.9, 10.0, 0.1, 20, 0.1, "dormant", ["vip"]), (None,) * 8], schema)
    best, worst, nothing = similarity.targeting_details(rows).collect()
    assert best.reasons == ["High conversion probability (34.38%)", "Low churn risk", "High predicted lifetime value", "Perfect fit for vip segment"] and best.risk_factors == best.suggestions == []
    assert worst.reasons == [] and worst.risk_factors == ["High churn risk", "Recent inactivity", "Low conversion probability"] and len(worst.suggestions) == 2
    assert nothing.reasons == nothing.risk_factors == nothing.suggestions == []


def test_advice_and_actionability_of_nothing(spark):
    schema = "algorithm string, silhouette double, davies_bouldin double, calinski_harabasz double, outlier_ratio double, stability double, n_clusters int, stability_level string"
    one = spark.createDataFrame([("a", 0.5, 1.0, 10.0, 0.3, 0.5, 2, "low"), ("b", 0.45, 1.0, 10.0, 0.0, 0.5, 5, "high")], schema)
    assert [r.advice for r in evaluation.algorithm_advice(one).collect()] == ["Adjust parameters to get more clusters", "Many outliers: check the quality of the data", "Unstable clusters: consider more data or other features", "Little difference to b: consider both"]
    assert evaluation.algorithm_advice(one.limit(0)).count() == 0 and evaluation.algorithm_advice(one.where("algorithm = 'b'")).count() == 1
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.2), ("z", None), ("w", 0.04)], "feature string, p double")
    assert tuple(evaluation.actionability(tests).first()) == (4, 2, 0.5) and tuple(evaluation.actionability(tests.limit(0)).first()) == (0, 0, 0.0)


def test_csv_export_of_odd_values(spark):
    rows = spark.createDataFrame([(1, 'a,"b"\nc', None, [1, 2]), (2, "x", 1.5, None)], "user_id long, `note, of` string, amount double, parts array<int>")
    frames = {"t": rows}
    assert sinks.csv_headers(frames) == {"t": 'amount,"note, of",parts,user_id'}
    found = sinks.export_subject(frames, rows.select("user_id"), fmt="csv").select("user_id", F.from_csv("record", "amount double, note string, parts string, user_id long", {"multiLine": "true"}).alias("x")).orderBy("user_id").collect()
    assert [tuple(r.x) for r in found] == [(None, 'a,"b"\nc', "[1,2]", 1), (1.5, "x", None, 2)]
    with pytest.raises(ValueError, match="format"):
        sinks.export_subject(frames, rows.select("user_id"), fmt="xml")
