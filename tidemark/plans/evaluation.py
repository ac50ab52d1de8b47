"""Queries of cluster evaluation, consensus, anomalies and interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.significance import p_value_f
from ..operators import clustering as c
from ..operators import evaluation as ops
from ..operators import hierarchy
from ..sources.shared import written
from . import views as v
from .models import _COLUMNS, _LABELLED, _labelled, _matrix
from .registry import query

_LONG = "e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings), ce as (select label, d, avg(x) as m from e group by 1, 2)"
_QUALITY = "with " + _LONG + """, p as (select e.label, vec_id, sqrt(sum((x - m) * (x - m))) as r from e join ce on ce.label = e.label and ce.d = e.d group by 1, 2), s as (select label, count(*) as size, avg(r) as a from p group by 1),
k as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label order by vec_id) as k from embeddings), i as (select a.label, avg(list_distance(a.v, b.v)) as i from k a join k b on a.label = b.label and a.k < b.k where a.k <= 100 and b.k <= 100 group by 1),
q as (select s.label, size, 1 / (a + 1e-8) as density, a as avg_distance_to_centroid, coalesce(i, 0) as avg_internal_distance from s left join i on i.label = s.label),
r as (select *, case when size < 2 then 'too_small' when size < 5 then 'very_small' when density < (select quantile_cont(density, 0.1) from q where size >= 2) then 'low_density' end as issue from q)"""


@query(_QUALITY + " select * from r", (), "density avg_distance_to_centroid avg_internal_distance")
def cluster_quality(spark, sf):
    return ops.cluster_quality(v.vectors(spark, sf), "vec_id", "embedding")


@query(_QUALITY + " select avg(size) as avg_cluster_size, stddev_pop(size) as std_cluster_size, stddev_pop(size) / avg(size) as size_imbalance, avg(density) as avg_density, stddev_pop(density) as density_variation, count(issue) as problematic_clusters from r", (), "avg_cluster_size std_cluster_size size_imbalance avg_density density_variation")
def quality_summary(spark, sf):
    return ops.quality_summary(ops.cluster_quality(v.vectors(spark, sf), "vec_id", "embedding"))


@query()
def kmeans_large(spark, sf):
    return ops.kmeans_large(v.vectors(spark, sf).select("vec_id", "embedding"), range(3, 6), "embedding")[1].select("vec_id", "label", "distance")


@query()
def bootstrap_stability(spark, sf):
    return ops.bootstrap_stability(_matrix(spark, sf), 4, 3)


@query()
def dbscan_predict(spark, sf):
    rows = written(_matrix(spark, sf), "dbscan-rows")
    known, new = rows.where("user_id % 5 <> 0"), rows.where("user_id % 5 = 0")
    found = hierarchy.dbscan(known, "user_id", "features", 0.9, 4, 3).where("is_core").join(known, "user_id")
    return ops.dbscan_predict(new, found, "user_id", "features", 0.9, 3)


#: Measures per label stand in for those of algorithms.
_EVAL = """ev as (select label as algorithm, avg(embedding[1]) as silhouette, abs(avg(embedding[2])) + 0.5 as davies_bouldin, count(*)::double as calinski_harabasz, label / 20.0::double as outlier_ratio, avg(abs(embedding[3])) as stability, avg(embedding[4]) * 10 as consensus from embeddings group by label)"""


def _evaluations(spark, sf):
    x = lambda i: F.col("embedding")[i].cast("double")
    return v.vectors(spark, sf).groupBy(F.col("label").alias("algorithm")).agg(
        F.avg(x(0)).alias("silhouette"), (F.abs(F.avg(x(1))) + 0.5).alias("davies_bouldin"), F.count("*").cast("double").alias("calinski_harabasz"), (F.max("label") / 20.0).alias("outlier_ratio"), F.avg(F.abs(x(2))).alias("stability"), (F.avg(x(3)) * 10).alias("consensus"))


@query("with " + _EVAL + """, s as (select algorithm, ((silhouette + 1) / 2 + 1 / (1 + davies_bouldin) + least(calinski_harabasz / 1000, 1)) * case when outlier_ratio > 0.3 then 1 - outlier_ratio else 1 end + stability * 0.2 as score from ev) select *, cast(row_number() over (order by score desc, algorithm) as int) as rank from s""", (), "score")
def compare_algorithms(spark, sf):
    return ops.compare_algorithms(_evaluations(spark, sf))


@query("with " + _EVAL + """, m as (select label as algorithm, count(distinct vec_id % 13) as n_clusters, case when avg(abs(embedding[3])) < 0.05 then 'low' else 'high' end as stability_level from embeddings group by 1),
s as (select algorithm, ((silhouette + 1) / 2 + 1 / (1 + davies_bouldin) + least(calinski_harabasz / 1000, 1)) * case when outlier_ratio > 0.3 then 1 - outlier_ratio else 1 end + stability * 0.2 as score, outlier_ratio from ev),
r as (select *, lead(algorithm) over w as second, lead(score) over w as behind, row_number() over w as k from s window w as (order by score desc, algorithm)),
a as (select algorithm, unnest([case when n_clusters < 3 then 'Adjust parameters to get more clusters' when n_clusters > 10 then 'Many clusters: consider simplifying' end, case when outlier_ratio > 0.2 then 'Many outliers: check the quality of the data' end,
  case stability_level when 'low' then 'Unstable clusters: consider more data or other features' when 'high' then 'Stable clusters: fit for production' end, case when score - behind < 0.1 then 'Little difference to ' || second || ': consider both' end]) as advice from r join m using (algorithm) where k = 1) select * from a where advice is not null""", ())
def algorithm_advice(spark, sf):
    x = F.abs(F.col("embedding")[2].cast("double"))
    more = v.vectors(spark, sf).groupBy(F.col("label").alias("algorithm")).agg(F.countDistinct(F.col("vec_id") % 13).alias("n_clusters"), F.when(F.avg(x) < 0.05, "low").otherwise("high").alias("stability_level"))
    return ops.algorithm_advice(_evaluations(spark, sf).join(more, "algorithm"))


@query("with " + _EVAL + """, q as (select algorithm, consensus, silhouette * 0.4 + 1 / (1 + davies_bouldin) * 0.3 + calinski_harabasz / 1000 * 0.2 + (1 - abs(outlier_ratio - 0.1)) * 0.1 as q from ev)
select algorithm, q / sum(q) over () as quality, 0.7 * q / sum(q) over () + 0.3 * greatest(consensus, 0) / sum(greatest(consensus, 0)) over () as adaptive from q""", (), "quality adaptive")
def ensemble_weights(spark, sf):
    e = _evaluations(spark, sf)
    return ops.ensemble_weights(e).withColumnRenamed("weight", "quality").join(ops.ensemble_weights(e, "adaptive").withColumnRenamed("weight", "adaptive"), "algorithm")


_THREE = "t as (select vec_id, label as l1, cast(vec_id % 7 as int) - 1 as l2, cast(vec_id % 3 as int) as l3 from embeddings), cl as (select l1, l2, l3, min(vec_id) as c from t group by 1, 2, 3)"


def _three(spark, sf):
    return v.vectors(spark, sf).select("vec_id", F.col("label").alias("l1"), (F.col("vec_id") % 7 - 1).cast("int").alias("l2"), (F.col("vec_id") % 3).cast("int").alias("l3"))


@query("with " + _THREE + ", w as (" + " union all ".join(f"select x.c as a, y.c as b, {w} as w from cl x join cl y on x.{i} = y.{i} and x.c < y.c where x.{i} <> -1" for i, w in (("l1", 0.5), ("l2", 0.3), ("l3", 0.2))) + ") select a, b, sum(w)::double as consensus from w group by 1, 2", (), "consensus")
def consensus_pairs(spark, sf):
    return ops.consensus_pairs(_three(spark, sf), "vec_id", ["l1", "l2", "l3"], [0.5, 0.3, 0.2])[0]


@query("with " + _THREE + " select vec_id, c as class from t join cl on cl.l1 = t.l1 and cl.l2 = t.l2 and cl.l3 = t.l3")
def consensus_members(spark, sf):
    return ops.consensus_pairs(_three(spark, sf), "vec_id", ["l1", "l2", "l3"], [0.5, 0.3, 0.2])[1]


@query()
def ensemble_spectral(spark, sf):
    return ops.ensemble_spectral(_three(spark, sf), "vec_id", ["l1", "l2", "l3"], [0.5, 0.3, 0.2])


@query()
def isolation_forest(spark, sf):
    return ops.isolation_forest(v.bets(spark, sf), "event_id", ["bet_amount", "session_duration", "games_played"])


@query()
def cluster_sample(spark, sf):
    return ops.cluster_sample(v.bets(spark, sf).select("event_id", "bet_amount", "session_duration"), "event_id", ["bet_amount", "session_duration"], 20)


def _tested(spark, sf):
    rows = _labelled(spark, sf)
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    f = c.business_separation(rows, _COLUMNS).crossJoin(F.broadcast(n)).withColumn("p", p_value_f(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")))
    return f


@query()
def business_significance(spark, sf):
    """p of the analysis of variance of each measure, and whether it can be acted on (p under 0.05, eta squared over 0.06)."""
    return _tested(spark, sf).select("feature", "f", "p", "eta_squared", ((F.col("p") < 0.05) & (F.col("eta_squared") > 0.06)).alias("actionable"))


@query()
def actionability(spark, sf):
    """Share of the measures that the labels set apart."""
    return ops.actionability(_tested(spark, sf))


_PERSONAS = """, ps as (select cast(user_id % 12 as int) as label, avg(bet_amount) * (1 + any_value(user_id % 12)) / 2 as avg_bet, stddev_samp(bet_amount) / avg(bet_amount) * (any_value(user_id % 12) % 4) as volatility, (sum(win_amount) - sum(bet_amount)) / sum(bet_amount) as roi, 1 / (1 + stddev_samp(session_duration) / avg(session_duration) * (any_value(user_id % 12) % 3)) as consistency, avg(games_played) / 10 * (any_value(user_id % 12) % 3) as intensity, (any_value(user_id % 12) % 5) / 4.0::double as game_entropy,
avg(case when event_id % 3 = 0 then 1.0 else 0.0 end) as email, avg(case when event_id % 3 = 1 then 1.0 else 0.0 end) as sms, avg(case when event_id % 3 = 2 then 1.0 else 0.0 end) as push, avg(promotion_used) * (any_value(user_id % 12) % 3) / 2 as response_rate, cast(any_value(user_id % 12) * 2 as double) as contact_hour, avg(case when dayofweek(timestamp) in (0, 6) then 1.0 else 0.0 end) * (any_value(user_id % 12) % 4) as weekend_ratio from bets group by 1),
pe as (select label, case when avg_bet >= 1000 then 'whale' when avg_bet >= 100 then 'high_roller' when avg_bet >= 20 then 'regular' when avg_bet > 0 then 'casual' end as spending_tier, case when volatility > 2 then 'high_risk' when volatility > 1 then 'moderate_risk' else 'low_risk' end as risk_profile, case when roi > 0.1 then 'profitable' when roi > -0.1 then 'break_even' else 'losing' end as profitability, case when consistency > 0.8 then 'highly_consistent' when consistency > 0.5 then 'moderately_consistent' else 'inconsistent' end as consistency_level,
case when intensity > 0.8 then 'highly_engaged' when intensity > 0.5 then 'moderately_engaged' else 'low_engaged' end as engagement_level, case when game_entropy > 0.8 then 'diverse_explorer' when game_entropy > 0.5 then 'moderate_variety' else 'focused_specialist' end as game_preference, case when email >= sms and email >= push then 'email' when sms >= push then 'sms' else 'push' end as preferred_channel, case when response_rate > 0.3 then 'highly_responsive' when response_rate > 0.15 then 'moderately_responsive' else 'low_responsive' end as responsiveness,
case when contact_hour between 6 and 11 then 'morning' when contact_hour between 12 and 17 then 'afternoon' when contact_hour between 18 and 22 then 'evening' else 'late_night' end as activity_period, case when weekend_ratio > 0.6 then 'weekend_focused' when weekend_ratio < 0.3 then 'weekday_focused' else 'balanced' end as weekly_pattern from ps)"""


def _personas(spark, sf):
    k = (F.col("user_id") % 12).cast("int")
    of = lambda x: F.avg(x.cast("double"))
    label = F.max("label")
    return v.bets(spark, sf).withColumn("label", k).groupBy("label").agg(
        (F.avg("bet_amount") * (1 + label) / 2).alias("avg_bet"), (F.stddev_samp("bet_amount") / F.avg("bet_amount") * (label % 4)).alias("volatility"), ((F.sum("win_amount") - F.sum("bet_amount")) / F.sum("bet_amount")).alias("roi"),
        (1 / (1 + F.stddev_samp("session_duration") / F.avg("session_duration") * (label % 3))).alias("consistency"), (F.avg("games_played") / 10 * (label % 3)).alias("intensity"), (label % 5 / 4.0).alias("game_entropy"),
        *[of(F.col("event_id") % 3 == i).alias(x) for i, x in enumerate(("email", "sms", "push"))], (F.avg("promotion_used") * (label % 3) / 2).alias("response_rate"), (label * 2).cast("double").alias("contact_hour"),
        (of(F.dayofweek("timestamp").isin(1, 7)) * (label % 4)).alias("weekend_ratio"))


@query(_PERSONAS + " select * from pe", (v.BETS,))
def persona(spark, sf):
    return ops.persona(_personas(spark, sf))


def _texts(cases: list[tuple[str, list[str]]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"case when {when} then '{'; '.join(texts)}' end" for when, texts in cases) + ")"


_VALUE = "spending_tier in ('whale', 'high_roller')"
_RISKS = _texts([("risk_profile = 'high_risk'", [ops.RISKS["high_risk"]]), ("profitability = 'losing'", [ops.RISKS["losing"]]), ("consistency_level = 'inconsistent'", [ops.RISKS["inconsistent"]]), ("engagement_level = 'low_engaged'", [ops.RISKS["low_engaged"]]), ("responsiveness = 'low_responsive'", [ops.RISKS["low_responsive"]])])
_CHANCES = _texts([(_VALUE, [ops.OPPORTUNITIES["valuable"]]), ("profitability = 'profitable'", [ops.OPPORTUNITIES["profitable"]]), ("engagement_level = 'highly_engaged'", [ops.OPPORTUNITIES["highly_engaged"]]), ("game_preference = 'diverse_explorer'", [ops.OPPORTUNITIES["diverse_explorer"]]), ("responsiveness = 'highly_responsive'", [ops.OPPORTUNITIES["highly_responsive"]])])
_CONTENT = _texts([(_VALUE, ops.CONTENT["valuable"]), ("game_preference = 'diverse_explorer'", ops.CONTENT["diverse_explorer"]), ("risk_profile = 'high_risk'", ops.CONTENT["high_risk"])])
_COUNT = "(" + " + ".join(f"cast({x} as int)" for x in ("risk_profile = 'high_risk'", "profitability = 'losing'", "consistency_level = 'inconsistent'", "engagement_level = 'low_engaged'", "responsiveness = 'low_responsive'")) + ")"


@query(_PERSONAS + f""" select label, {_RISKS} as risks, {_CHANCES} as opportunities, case when {_VALUE} then 'retention_and_growth' when {_COUNT} > 2 then 'risk_mitigation' when engagement_level = 'low_engaged' then 'engagement_boost' else 'value_optimization' end as objective, case when {_VALUE} then 'high_value' when {_COUNT} > 2 then 'at_risk' else 'casual' end as template, preferred_channel as channel, activity_period as timing,
case when engagement_level = 'highly_engaged' and responsiveness = 'highly_responsive' then 'weekly' when engagement_level = 'low_engaged' or responsiveness = 'low_responsive' then 'monthly' else 'bi_weekly' end as frequency, case when {_CONTENT} = '' then '{"; ".join(ops.CONTENT["other"])}' else {_CONTENT} end as content, case when {_COUNT} < 2 then 'low' else 'high' end as risk_level,
{_texts([(_VALUE, ops.TACTICS["valuable"]), ("engagement_level = 'low_engaged'", ops.TACTICS["low_engaged"])])} as retention_tactics, case when {_VALUE} then 'revenue_retention' when {_COUNT} > 2 then 'risk_mitigation_success' else 'customer_lifetime_value' end as primary_kpi from pe""", (v.BETS,))
def strategy(spark, sf):
    rows = ops.strategy(ops.persona(_personas(spark, sf)))
    return rows.select(*[F.array_join(x, "; ").alias(x) if t.startswith("array") else F.col(x) for x, t in rows.dtypes])


@query(""", ci as (select cast(user_id % 6 as int) as label, bet_amount * (1 + user_id % 6) as avg_bet_amount, games_played * (user_id % 6) as session_frequency, hour(timestamp) as preferred_hour, (user_id % 6) * 3.0 as days_since_last_bet from bets), m as (select label, avg(avg_bet_amount) b, avg(session_frequency) f, avg(preferred_hour) h, avg(days_since_last_bet) d from ci group by 1)
select label, case when b > 100 then 'High roller' when b > 20 then 'Medium spender' else 'Casual player' end as spending_level, case when f > 20 then 'Highly active' when f > 10 then 'Moderately active' else 'Low activity' end as activity_level, case when h between 6 and 12 then 'Morning player' when h between 12 and 18 then 'Afternoon player' when h between 18 and 24 then 'Evening player' else 'Night owl' end as play_time, """
       + _texts([("b > 100", ops.OFFERS["high"]), ("b > 20 and b <= 100", ops.OFFERS["medium"]), ("b <= 20", ops.OFFERS["casual"]), ("f < 5", ops.OFFERS["rare"]), ("d > 7", ops.OFFERS["inactive"])]) + " as campaigns from m", (v.BETS,))
def cluster_insights(spark, sf):
    k = F.col("user_id") % 6
    rows = v.bets(spark, sf).select(k.cast("int").alias("label"), (F.col("bet_amount") * (1 + k)).alias("avg_bet_amount"), (F.col("games_played") * k).alias("session_frequency"), F.hour("timestamp").alias("preferred_hour"), (k * 3.0).alias("days_since_last_bet"))
    return ops.cluster_insights(rows).withColumn("campaigns", F.array_join("campaigns", "; "))


_REPORT = _LABELLED + ", z as (select count(*) t from bets), n as (select label, count(*) / 3 as size from l group by 1), pf as (select l.label, feature, any_value(size)::bigint as size, any_value(size) * 100 / any_value(t) as percentage, avg(x) as mean, median(x) as median, stddev_samp(x) as std from l join n on n.label = l.label, z group by 1, 2)"
_CELLS = ", ".join(f"max({m}) filter (where feature = '{x}') as {x}_{m}" for x in _COLUMNS for m in ("mean", "median"))


@query(_REPORT + f" select label, max(size) as size, max(percentage) as percentage, {_CELLS} from pf group by label", (v.BETS,), "percentage " + " ".join(f"{x}_{m}" for x in _COLUMNS for m in ("mean", "median")))
def cluster_report(spark, sf):
    return ops.cluster_report(c.cluster_profiles(_labelled(spark, sf), _COLUMNS), _COLUMNS)


@query(_REPORT + """, o as (select * from pf where feature = 'bet_amount' and label <> -1) select count(*) as clusters, cast(sum(size) as bigint) as rows, (select label from o order by size desc, label limit 1) as largest, (select label from o order by mean desc, label limit 1) as highest_value, (select label from o order by std / abs(mean) desc, label limit 1) as most_volatile from o""", (v.BETS,))
def cluster_summary(spark, sf):
    return ops.cluster_summary(c.cluster_profiles(_labelled(spark, sf), _COLUMNS), "bet_amount")


@query(_REPORT + " select event_id, cast(user_id % 4 as int) - 1 as cluster, 'cluster_' || (user_id % 4 - 1) as name, size, mean as mean_bet_amount from bets join pf on pf.label = cast(user_id % 4 as int) - 1 and feature = 'bet_amount'", (v.BETS,), "mean_bet_amount")
def export_for_campaigns(spark, sf):
    rows = _labelled(spark, sf)
    out = ops.export_for_campaigns(rows, c.cluster_profiles(rows, ["bet_amount"]), ["bet_amount"], "event_id")
    path = written(out, "export").inputFiles()[0].rsplit("/", 1)[0]
    csv = f"{path}-csv"
    out.write.option("header", True).csv(csv)
    return spark.read.schema(out.schema).option("header", True).csv(csv)


@query()
def adjusted_mutual_information(spark, sf):
    return ops.adjusted_mutual_information(v.vectors(spark, sf).withColumn("other", (F.col("label") + F.col("vec_id") % 2).cast("int")), "label", "other")


@query()
def silhouette(spark, sf):
    return ops.silhouette(v.vectors(spark, sf), "vec_id", "embedding")


@query()
def kth_distances(spark, sf):
    return ops.kth_distances(_matrix(spark, sf), "user_id")


@query()
def dbscan_grid(spark, sf):
    """A grid around the bend of the k-th distances."""
    rows = written(_matrix(spark, sf), "dbscan-rows")
    eps = ops.dbscan_eps(rows, "user_id")
    return ops.dbscan_grid(rows, "user_id", "features", 3, [eps, 1.5 * eps], [4])


@query(_LABELLED + " select feature, label = -1 as is_outlier, count(x) as n, avg(x) as mean, median(x) as median, stddev_samp(x) as std from l group by 1, 2", (v.BETS,), "mean median std")
def outlier_spread(spark, sf):
    return ops.outlier_spread(_labelled(spark, sf), _COLUMNS)


_AGREE = _THREE.replace(", cl as", ", cx as") + """, m2 as (select l2, l1, row_number() over (partition by l2 order by count(*) desc, l1) as k from t where l2 <> -1 and l1 <> -1 group by 1, 2), m3 as (select l3, l1, row_number() over (partition by l3 order by count(*) desc, l1) as k from t where l3 <> -1 and l1 <> -1 group by 1, 2),
vo as (select vec_id, l1 as label, 1.0::double / 3 as w from t union all select vec_id, coalesce(m2.l1, t.l2), 1.0::double / 3 from t left join m2 on m2.l2 = t.l2 and k = 1 union all select vec_id, coalesce(m3.l1, t.l3), 1.0::double / 3 from t left join m3 on m3.l3 = t.l3 and k = 1),
g as (select vec_id, label, sum(w) as w from vo group by 1, 2), r as (select *, row_number() over (partition by vec_id order by round(w, 9) desc, label) as k from g), en as (select vec_id, case when w >= 0.6 then label else -1 end as label, w as agreement from r where k = 1)"""


@query("with " + _AGREE + " select label, count(*) as n, avg(agreement) as mean, median(agreement) as median, min(agreement) as least, avg(case when agreement > 0.8 then 1.0 else 0.0 end) as stable, avg(case when agreement < 0.5 then 1.0 else 0.0 end) as unstable from en group by label", (), "mean median least stable unstable")
def vote_stability(spark, sf):
    """Stability of the vote of three labelings of the vectors."""
    rows = _three(spark, sf)
    votes = c.ensemble_vote([rows.select("vec_id", F.col(x).alias("label")) for x in ("l1", "l2", "l3")], [1.0, 1.0, 1.0], "vec_id")
    return c.ensemble_stability(votes)


@query("""with x as (select vec_id, label, list_transform(embedding, lambda e: e::double) as v from embeddings), m as (select label, i, avg(v[i]) as c from x, unnest(range(1, len(v) + 1)) as t(i) group by 1, 2),
k as (select label as l2, list(c order by i) as centre from m group by 1), q as (select label as l2, count(*) as n, avg(list_dot_product(v, v)) as sq from x group by 1),
d as (select vec_id, label, l2, n, greatest(0, list_dot_product(v, v) - 2 * list_dot_product(v, centre) + sq) as d from x, k join q using (l2)),
s as (select vec_id, label, max(case when l2 = label then n end) as n, max(case when l2 = label then d * n / (n - 1) end) as a, min(case when l2 <> label then d end) as b from d group by 1, 2)
select label, count(*) as n, avg(case when n > 1 then (b - a) / greatest(a, b) else 0 end) as silhouette from s group by label""", (), "silhouette")
def squared_silhouette(spark, sf):
    return ops.squared_silhouette(v.vectors(spark, sf), "embedding")
