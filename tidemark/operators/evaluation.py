"""Quality, stability and comparison of clusterings, consensus of several, and what clusters mean for campaigns."""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.order import grouped_quantiles
from ..functions.stats import EPSILON, one_row
from . import clustering as c
from . import hierarchy


def kmeans_large(df: DataFrame, ks: range, features: str = "features", sample: int = 5000, seed: int = 42) -> tuple[int, DataFrame]:
    """(k, rows with label, distance, confidence): every k is fitted on all rows, and that of the best silhouette over a
    bounded sample of ``sample`` rows is taken, the smallest among equals."""
    n = df.count()
    rows = df.cache()
    some = rows if n <= sample else rows.sample(sample / n, seed)
    best = None
    for k in ks:
        model, _ = c.kmeans(rows, k, features, seed)
        labelled = c.assign_clusters(model, some, features).withColumn("_v", array_to_vector(features))
        score = ClusteringEvaluator(featuresCol="_v", predictionCol="label").evaluate(labelled)
        if best is None or score > best[0] + 1e-12:
            best = (score, k, model)
    rows.unpersist()
    return best[1], c.assign_clusters(best[2], df, features)


def dbscan_predict(points: DataFrame, cores: DataFrame, key: str, features: str, eps: float, dimensions: int, leaf_size: int = 1024) -> DataFrame:
    """(key, label): label of the nearest core point (features, label) within 1.5 eps, ties to the smaller label, else noise.
    Points meet the leaves of cores that may hold their nearest, as matrices; what is not whole and finite is noise."""
    known = hierarchy.fine_points(cores, "label", features, dimensions)
    asks = hierarchy.fine_points(points, key, features, dimensions)
    if known is None or asks is None:
        return points.select(key, F.lit(c.NOISE).cast("long").alias("label"))
    # a node's id is the smallest label of its vector, so that equal distances go by labels
    targets, rows = hierarchy.leaves_of(known, leaf_size), hierarchy.leaves_of(asks, leaf_size)
    best = hierarchy.nearest_targets(rows, targets, dimensions, 1, 1.5 * eps).select("id", F.col("near")[0]["other"].alias("label"))
    found = asks.join(rows.select("id", "x").join(best, "id"), "x").select(F.col("key").alias(key), "label")
    return points.select(key).join(found, key, "left").select(key, F.coalesce("label", F.lit(c.NOISE).cast("long")).alias("label"))


def cluster_quality(df: DataFrame, key: str, features: str = "features", most: int = 100) -> DataFrame:
    """(label, size, density, avg_distance_to_centroid, avg_internal_distance, issue): density is 1 over the mean distance to
    the centre; internal distances are those among the ``most`` rows of smallest key; an issue is too_small (1 row),
    very_small (under 5) or low_density (under the tenth percentile of densities). Noise is left out."""
    centre = c.centroids(df, features)
    rows = df.where(F.col("label") != c.NOISE).select(key, "label", F.col(features).cast("array<double>").alias("_v"))
    per = rows.join(F.broadcast(centre), "label").groupBy("label").agg(F.max("n").alias("size"), F.avg(F.sqrt(c.squared_distance(F.col("_v"), F.col("centre")))).alias("avg_distance_to_centroid"))
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(key))).where(F.col("_k") <= most)
    other = few.select("label", F.col("_k").alias("_j"), F.col("_v").alias("_w"))
    inner = few.join(other, "label").where("_k < _j").groupBy("label").agg(F.avg(F.sqrt(c.squared_distance(F.col("_v"), F.col("_w")))).alias("avg_internal_distance"))
    rows = per.join(inner, "label", "left").withColumn("density", 1 / (F.col("avg_distance_to_centroid") + EPSILON))
    low = one_row(rows.where("size >= 2"), F.percentile("density", F.lit(0.1)).alias("_low"))
    issue = F.when(F.col("size") < 2, "too_small").when(F.col("size") < 5, "very_small").when(F.col("density") < F.col("_low"), "low_density")
    return rows.crossJoin(low).select("label", "size", "density", "avg_distance_to_centroid", F.coalesce("avg_internal_distance", F.lit(0.0)).alias("avg_internal_distance"), issue.alias("issue"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """One row over ``cluster_quality``: sizes, their imbalance, densities and the number of clusters with an issue."""
    return quality.agg(
        F.avg("size").alias("avg_cluster_size"), F.stddev_pop("size").alias("std_cluster_size"), (F.stddev_pop("size") / F.avg("size")).alias("size_imbalance"),
        F.avg("density").alias("avg_density"), F.stddev_pop("density").alias("density_variation"), F.count("issue").alias("problematic_clusters"))


def bootstrap_stability(df: DataFrame, k: int, n: int = 5, features: str = "features", seed: int = 42) -> DataFrame:
    """(resample, ari, level): agreement of the labels of all rows by a fit on a resample with those by the fit on all rows;
    stable from 0.8, moderate from 0.6. The fits are distributed; one row of each comes back."""
    base = c.kmeans(df, k, features, seed)[0]
    out = None
    for i in range(n):
        model = c.kmeans(df.sample(True, 1.0, seed + i), k, features, seed)[0]
        both = c.assign_clusters(model, c.assign_clusters(base, df, features).select(features, F.col("label").alias("a")), features)
        one = c.external_metrics(both, "a", "label").select(F.lit(i).alias("resample"), "ari")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("level", F.when(F.col("ari") >= 0.8, "stable").when(F.col("ari") >= 0.6, "moderate").otherwise("unstable"))


def compare_algorithms(evaluations: DataFrame) -> DataFrame:
    """(algorithm, score, rank) over (algorithm, silhouette, davies_bouldin, calinski_harabasz, outlier_ratio, stability):
    measures scaled to 0..1 and added, cut by the share of outliers over 0.3, plus a fifth of the stability. Missing
    measures add nothing (a missing silhouette counts as 0)."""
    s, d, h, o = F.coalesce("silhouette", F.lit(0.0)), F.col("davies_bouldin"), F.col("calinski_harabasz"), F.coalesce("outlier_ratio", F.lit(0.0))
    score = (s + 1) / 2 + F.when(d > 0, 1 / (1 + d)).otherwise(0.0) + F.when(h > 0, F.least(h / 1000, F.lit(1.0))).otherwise(0.0)
    score = score * F.when(o > 0.3, 1 - o).otherwise(1.0) + F.coalesce("stability", F.lit(0.0)) * 0.2
    rows = evaluations.select("algorithm", score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "algorithm")))  # a row per algorithm


def algorithm_advice(evaluations: DataFrame, close: float = 0.1) -> DataFrame:
    """(algorithm, advice) of the best of ``compare_algorithms``: a row for each piece of advice, from its n_clusters, outlier_ratio
    and stability_level, and one for the second where its score is less than ``close`` behind. Missing measures give no advice;
    no evaluations give no rows."""
    ranked = compare_algorithms(evaluations)
    second = ranked.where("rank = 2").select(F.col("algorithm").cast("string").alias("second"), F.col("score").alias("second_score"))
    best = ranked.where("rank = 1").select("algorithm", "score").join(evaluations.drop("score"), "algorithm").join(second, F.lit(True), "left")
    # Texts of advice.
    texts = [
        F.when(F.col("n_clusters") < 3, "Adjust parameters to get more clusters").when(F.col("n_clusters") > 10, "Many clusters: consider simplifying"),
        F.when(F.col("outlier_ratio") > 0.2, "Many outliers: check the quality of the data"),
        F.when(F.col("stability_level") == "low", "Unstable clusters: consider more data or other features").when(F.col("stability_level") == "high", "Stable clusters: fit for production"),
        F.when(F.col("score") - F.col("second_score") < close, F.concat(F.lit("Little difference to "), "second", F.lit(": consider both"))),
    ]
    return best.select("algorithm", F.explode(F.array_compact(F.array(*texts))).alias("advice"))


def actionability(tests: DataFrame, p: float = 0.05) -> DataFrame:
    """One row (measures, actionable, share) over tests (feature, p): the share of measures that the clusters set apart. A null
    p counts as not set apart; no measures give a share of 0."""
    found = F.count(F.when(F.col("p") < p, 1))
    return tests.agg(F.count("*").alias("measures"), found.alias("actionable"), F.coalesce(found / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("share"))


def ensemble_weights(evaluations: DataFrame, strategy: str = "quality") -> DataFrame:
    """(algorithm, weight), adding up to 1. quality: silhouette 0.4, 1 / (1 + Davies-Bouldin) 0.3, Calinski-Harabasz / 1000
    0.2 and closeness to 10 % outliers 0.1, over the weights of the measures that are there; adaptive: 0.7 of that and
    0.3 of the share of ``consensus`` (sum of positive adjusted Rand indices with the others); equal."""
    if strategy not in ("equal", "quality", "adaptive"):
        raise ValueError(f"strategy {strategy!r}")
    parts = [(F.col("silhouette"), 0.4), (1 / (F.col("davies_bouldin") + 1), 0.3), (F.col("calinski_harabasz") / 1000, 0.2), (1 - F.abs(F.col("outlier_ratio") - 0.1), 0.1)]
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts), F.lit(0.0))
    quality = F.when(total > 0, sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0)) / total).otherwise(0.5)
    rows = evaluations.withColumn("_q", F.lit(1.0) if strategy == "equal" else quality)
    sums = one_row(rows, F.sum("_q").alias("_tq"), F.count("*").alias("_n"), *([F.sum(F.greatest("consensus", F.lit(0.0))).alias("_tc")] if strategy == "adaptive" else []))
    weight = F.when(F.col("_tq") > 0, F.col("_q") / F.col("_tq")).otherwise(1 / F.col("_n"))
    if strategy == "adaptive":
        weight = F.when(F.col("_tc") > 0, weight * 0.7 + F.greatest("consensus", F.lit(0.0)) / F.col("_tc") * 0.3).otherwise(weight)
    return rows.crossJoin(sums).select("algorithm", weight.alias("weight"))


def consensus_pairs(df: DataFrame, key: str, labels: list[str], weights: list[float]) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). Rows that all labelings treat alike are one class, named by its smallest key: members (key, class).
    pairs (a, b, consensus), a < b: classes that share a label other than noise in some labeling, with the share of weight
    of those. There are at most as many classes as combinations of labels, whatever the rows, and a class agrees with
    itself wherever it isn't noise."""
    classes = df.groupBy(*labels).agg(F.min(key).alias("class"))
    named = classes.select(*[F.col(x).alias(f"_{x}") for x in labels], "class")
    members = df.join(named, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in labels]).select(key, "class")
    met = None
    for x, w in zip(labels, weights, strict=True):
        one = classes.where(F.col(x) != c.NOISE).select(F.col(x).alias("l"), "class")
        pairs = one.select("l", F.col("class").alias("a")).join(one.select("l", F.col("class").alias("b")), "l").where("a < b").select("a", "b", F.lit(w / sum(weights)).alias("w"))
        met = pairs if met is None else met.unionByName(pairs)
    return met.groupBy("a", "b").agg(F.sum("w").alias("consensus")), members


def ensemble_spectral(df: DataFrame, key: str, labels: list[str], weights: list[float]) -> DataFrame:
    """(key, label): power-iteration clustering of the classes by their consensus, into as many clusters as the median
    labeling has; classes without any consensus are noise."""
    from pyspark.ml.clustering import PowerIterationClustering

    pairs, members = consensus_pairs(df, key, labels, weights)
    counts = df.agg(*[F.countDistinct(F.when(F.col(x) != c.NOISE, F.col(x))).alias(x) for x in labels]).first()
    k = max(2, int(np.median(list(counts))))
    found = PowerIterationClustering(k=k, maxIter=20, srcCol="a", dstCol="b", weightCol="consensus").assignClusters(pairs)
    out = members.join(found.select(F.col("id").alias("class"), F.col("cluster").alias("label")), "class", "left")
    return out.select(key, F.coalesce("label", F.lit(c.NOISE)).alias("label"))


# --- anomalies ---------------------------------------------------------------------------------------------


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple]:
    """Nodes (dimension or -1, cut, left, right, depth + correction) of one isolation tree."""
    nodes: list[tuple] = [()]
    open_: list[tuple[int, np.ndarray, int]] = [(0, np.arange(len(x)), 0)]
    while open_:
        at, rows, depth = open_.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) < 2 or not len(wide):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(_c(len(rows))))
            continue
        d = int(rng.choice(wide))
        cut = float(rng.uniform(low[d], high[d]))
        nodes[at] = (d, cut, len(nodes), len(nodes) + 1, 0.0)
        less = x[rows, d] < cut
        for part in (rows[less], rows[~less]):
            open_.append((len(nodes), part, depth + 1))
            nodes.append(())
    return nodes


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, score, is_anomaly, severity) of every row without nulls in the columns. Each tree is grown in a task of its
    own from about ``sample`` rows, chosen by a hash; the trees (of bounded size) are broadcast and score all rows in
    Arrow batches. score is minus 2 to the power of mean path over the usual path: the lowest ``contamination`` share
    (quantile to 1 in 10,000 ranks) is anomalous, medium below -0.5, else low. Under 10 rows nothing is returned."""
    rows = df.select(key, *[F.col(x).cast("double").alias(x) for x in columns]).dropna()
    stats = rows.agg(F.count("*").alias("n"), *[f(x).alias(f"{p}{x}") for x in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rows = rows.select(key, *[((F.col(x) - (stats[f"m{x}"] or 0.0)) / (stats[f"s{x}"] or 1.0)).alias(x) for x in columns])
    if stats.n < 10:
        return rows.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"), F.lit("").alias("severity"))
    share = min(1.0, sample / stats.n)
    place = lambda t: F.pmod(F.xxhash64(t, key), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < share)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[columns].to_numpy()
        nodes = _tree(x, np.random.default_rng([seed, t]), int(np.ceil(np.log2(max(2, len(x))))))
        return pd.DataFrame([(t, len(x), i, *node) for i, node in enumerate(nodes)], columns=["tree", "n", "node", "d", "cut", "left", "right", "depth"])

    schema = "tree int, n int, node int, d int, cut double, left int, right int, depth double"
    grown = picked.groupBy("tree").applyInPandas(grow, schema).toPandas()  # trees x (2 sample - 1) rows at most
    forest = [tuple(g.sort_values("node")[x].to_numpy() for x in ("d", "cut", "left", "right", "depth")) for _, g in grown.groupby("tree")]
    usual = float(_c(np.mean(grown.groupby("tree")["n"].first())))
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @pandas_udf(DoubleType())
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy() for p in parts])
        total, who = np.zeros(len(x)), np.arange(len(x))
        for d, cut, left, right, depth in sent.value:
            at = np.zeros(len(x), int)
            while (inner := d[at] >= 0).any():
                go = who[inner]
                less = x[go, d[at[go]]] < cut[at[go]]
                at[go] = np.where(less, left[at[go]], right[at[go]])
            total += depth[at]
        return pd.Series(-(2.0 ** (-total / len(sent.value) / usual)))

    scored = rows.select(key, score(*[F.col(x) for x in columns]).alias("score"))
    bound = one_row(scored, F.percentile_approx("score", F.lit(contamination), F.lit(10_000)).alias("_bound"))
    odd = F.col("score") <= F.col("_bound")
    return scored.crossJoin(bound).select(key, "score", odd.alias("is_anomaly"), F.when(odd, F.when(F.col("score") < -0.5, "medium").otherwise("low")).alias("severity"))


def cluster_sample(df: DataFrame, key: str, columns: list[str], n: int, seed: int = 42) -> DataFrame:
    """Up to n rows that stand for all: of n clusters the row nearest to each centre, ties to the smaller key."""
    rows = df.withColumn("features", F.array(*[F.col(x).cast("double") for x in columns]))
    labelled = c.kmeans(rows, n, seed=seed)[1]
    first = labelled.groupBy("label").agg(F.min(F.struct("distance", key)).alias("_m")).select(F.col(f"_m.{key}").alias(key), "label")
    return df.join(F.broadcast(first), key)


# --- meaning -----------------------------------------------------------------------------------------------

# Texts of reports.
RISKS = {
    "high_risk": "Alto risco: apostas voláteis podem indicar problema de jogo", "losing": "Perdas consistentes podem levar ao abandono", "inconsistent": "Comportamento imprevisível dificulta retenção",
    "low_engaged": "Baixo engajamento aumenta risco de churn", "low_responsive": "Baixa responsividade limita eficácia das campanhas"}
OPPORTUNITIES = {
    "valuable": "Alto valor: potencial para programas VIP exclusivos", "profitable": "Usuário lucrativo: incentivar maior atividade", "highly_engaged": "Alto engajamento: potencial para cross-selling",
    "diverse_explorer": "Explorador: receptivo a novos jogos e features", "highly_responsive": "Altamente responsivo: ideal para campanhas direcionadas"}
CONTENT = {"valuable": ["exclusive_offers", "vip_events", "personal_account_manager"], "diverse_explorer": ["new_game_announcements", "game_tutorials"], "high_risk": ["responsible_gaming_tips", "limit_setting_tools"], "other": ["general_promotions", "game_tips", "community_updates"]}
TACTICS = {"valuable": ["vip_treatment", "dedicated_support", "exclusive_bonuses"], "low_engaged": ["engagement_campaigns", "educational_content", "gamification"]}
OFFERS = {"high": ["VIP exclusive bonuses and personalized offers", "High-limit game promotions"], "medium": ["Deposit match bonuses", "Weekend special offers"], "casual": ["Welcome bonuses and free spins", "Low-risk game promotions"], "rare": ["Re-engagement campaigns", "Win-back offers"], "inactive": ["Urgent retention campaigns", "Special comeback bonuses"]}


def _level(x: str, *steps: tuple[float, str], other: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(F.col(x) > least, name) if out is None else out.when(F.col(x) > least, name)
    return out.otherwise(other)


def persona(profiles: DataFrame) -> DataFrame:
    """Labels of each cluster over (label, avg_bet, volatility, roi, consistency, intensity, game_entropy, email, sms, push,
    response_rate, contact_hour, weekend_ratio). A missing value falls into the last class of its rule; the channel is
    the first of the largest shares."""
    bet, hour, w = F.col("avg_bet"), F.col("contact_hour"), F.col("weekend_ratio")
    return profiles.select(
        "label", F.when(bet >= 1000, "whale").when(bet >= 100, "high_roller").when(bet >= 20, "regular").when(bet > 0, "casual").alias("spending_tier"),
        _level("volatility", (2.0, "high_risk"), (1.0, "moderate_risk"), other="low_risk").alias("risk_profile"), _level("roi", (0.1, "profitable"), (-0.1, "break_even"), other="losing").alias("profitability"),
        _level("consistency", (0.8, "highly_consistent"), (0.5, "moderately_consistent"), other="inconsistent").alias("consistency_level"),
        _level("intensity", (0.8, "highly_engaged"), (0.5, "moderately_engaged"), other="low_engaged").alias("engagement_level"),
        _level("game_entropy", (0.8, "diverse_explorer"), (0.5, "moderate_variety"), other="focused_specialist").alias("game_preference"),
        F.when(F.col("email") >= F.greatest("sms", "push"), "email").when(F.col("sms") >= F.col("push"), "sms").otherwise("push").alias("preferred_channel"),
        _level("response_rate", (0.3, "highly_responsive"), (0.15, "moderately_responsive"), other="low_responsive").alias("responsiveness"),
        F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 22), "evening").otherwise("late_night").alias("activity_period"),
        F.when(w > 0.6, "weekend_focused").when(w < 0.3, "weekday_focused").otherwise("balanced").alias("weekly_pattern"))


def _listed(cases: list[tuple[Column, list[str]]]) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.flatten(F.filter(F.array(*[F.when(when, F.array(*[F.lit(x) for x in texts])).otherwise(none) for when, texts in cases]), lambda x: x.isNotNull()))


def strategy(personas: DataFrame) -> DataFrame:
    """Risks, opportunities, objective, template, channel, timing, frequency, content and retention of each persona."""
    is_ = lambda column, value: F.col(column) == value
    valuable = F.coalesce(F.col("spending_tier").isin("whale", "high_roller"), F.lit(False))
    risks = _listed([(is_("risk_profile", "high_risk"), [RISKS["high_risk"]]), (is_("profitability", "losing"), [RISKS["losing"]]), (is_("consistency_level", "inconsistent"), [RISKS["inconsistent"]]), (is_("engagement_level", "low_engaged"), [RISKS["low_engaged"]]), (is_("responsiveness", "low_responsive"), [RISKS["low_responsive"]])])
    chances = _listed([(valuable, [OPPORTUNITIES["valuable"]]), (is_("profitability", "profitable"), [OPPORTUNITIES["profitable"]]), (is_("engagement_level", "highly_engaged"), [OPPORTUNITIES["highly_engaged"]]), (is_("game_preference", "diverse_explorer"), [OPPORTUNITIES["diverse_explorer"]]), (is_("responsiveness", "highly_responsive"), [OPPORTUNITIES["highly_responsive"]])])
    content = _listed([(valuable, CONTENT["valuable"]), (is_("game_preference", "diverse_explorer"), CONTENT["diverse_explorer"]), (is_("risk_profile", "high_risk"), CONTENT["high_risk"])])
    rows = personas.withColumns({"risks": risks, "opportunities": chances, "content": content})
    many = F.size("risks") > 2
    return rows.select(
        "label", "risks", "opportunities", F.when(valuable, "retention_and_growth").when(many, "risk_mitigation").when(is_("engagement_level", "low_engaged"), "engagement_boost").otherwise("value_optimization").alias("objective"),
        F.when(valuable, "high_value").when(many, "at_risk").otherwise("casual").alias("template"), F.col("preferred_channel").alias("channel"), F.col("activity_period").alias("timing"),
        F.when(is_("engagement_level", "highly_engaged") & is_("responsiveness", "highly_responsive"), "weekly").when(is_("engagement_level", "low_engaged") | is_("responsiveness", "low_responsive"), "monthly").otherwise("bi_weekly").alias("frequency"),
        F.when(F.size("content") > 0, F.col("content")).otherwise(F.array(*[F.lit(x) for x in CONTENT["other"]])).alias("content"),
        F.when(F.size("risks") < 2, "low").otherwise("high").alias("risk_level"), _listed([(valuable, TACTICS["valuable"]), (is_("engagement_level", "low_engaged"), TACTICS["low_engaged"])]).alias("retention_tactics"),
        F.when(valuable, "revenue_retention").when(many, "risk_mitigation_success").otherwise("customer_lifetime_value").alias("primary_kpi"))


def cluster_insights(df: DataFrame) -> DataFrame:
    """(label, spending_level, activity_level, play_time, campaigns) from rows (label, avg_bet_amount, session_frequency,
    preferred_hour, days_since_last_bet), by cluster means."""
    m = df.groupBy("label").agg(F.avg("avg_bet_amount").alias("b"), F.avg("session_frequency").alias("f"), F.avg("preferred_hour").alias("h"), F.avg("days_since_last_bet").alias("d"))
    b, f, h, d = (F.col(x) for x in "bfhd")
    offers = _listed([(b > 100, OFFERS["high"]), ((b > 20) & (b <= 100), OFFERS["medium"]), (b <= 20, OFFERS["casual"]), (f < 5, OFFERS["rare"]), (d > 7, OFFERS["inactive"])])
    return m.select(
        "label", F.when(b > 100, "High roller").when(b > 20, "Medium spender").when(b.isNotNull(), "Casual player").alias("spending_level"), F.when(f > 20, "Highly active").when(f > 10, "Moderately active").when(f.isNotNull(), "Low activity").alias("activity_level"),
        F.when(h.between(6, 12), "Morning player").when(h.between(12, 18), "Afternoon player").when(h.between(18, 24), "Evening player").when(h.isNotNull(), "Night owl").alias("play_time"), offers.alias("campaigns"))


def cluster_report(profiles: DataFrame, features: list[str]) -> DataFrame:
    """One row per cluster of ``clustering.cluster_profiles``: size, percentage, and each feature's mean and median."""
    cells = [F.max(F.when(F.col("feature") == x, F.col(m))).alias(f"{x}_{m}") for x in features for m in ("mean", "median")]
    return profiles.groupBy("label").agg(F.max("size").alias("size"), F.max("percentage").alias("percentage"), *cells)


def cluster_summary(profiles: DataFrame, value: str) -> DataFrame:
    """One row: clusters, rows, and the labels of the largest, of the highest mean of ``value`` and of its highest relative
    spread; ties go to the smaller label."""
    one = profiles.where((F.col("feature") == value) & (F.col("label") != c.NOISE))
    top = lambda x: F.max_by("label", F.struct(x, -F.col("label")))
    return one.agg(F.count("*").alias("clusters"), F.sum("size").alias("rows"), top(F.col("size")).alias("largest"), top(F.col("mean")).alias("highest_value"), top(F.coalesce(F.col("std") / F.abs("mean"), F.lit(0.0))).alias("most_volatile"))


def export_for_campaigns(labels: DataFrame, profiles: DataFrame, features: list[str], key: str = "user_id") -> DataFrame:
    """(key, cluster, name, size, mean of each feature) of every row, to be written as CSV: labels with their clusters."""
    report = cluster_report(profiles, features)
    names = report.select(F.col("label").alias("cluster"), F.concat(F.lit("cluster_"), "label").alias("name"), "size", *[F.col(f"{x}_mean").alias(f"mean_{x}") for x in features])
    return labels.select(key, F.col("label").alias("cluster")).join(F.broadcast(names), "cluster").select(key, "cluster", "name", "size", *[f"mean_{x}" for x in features])


# --- more measures and choices -----------------------------------------------------------------------------


def _chance(x: int, y: int, n: int, spreads: float = 60.0) -> float:
    """Expected share of the mutual information of labels of x and y among n rows: over the counts that they can share, within so many
    spreads of the mean that the rest is below the last bit. One count's chance is had from the one before."""
    mean, low, high = x * y / n, max(1, x + y - n), min(x, y)
    spread = (mean * (1 - x / n) * (1 - y / n) * n / max(1, n - 1)) ** 0.5
    low, high = max(low, int(mean - spreads * (spread + 1))), min(high, int(mean + spreads * (spread + 1)) + 1)
    if high < low:
        return 0.0
    k = np.arange(low, high + 1, dtype=float)
    first = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(low + 1) - lgamma(x - low + 1) - lgamma(y - low + 1) - lgamma(n - x - y + low + 1)
    step = np.log((x - k[:-1]) * (y - k[:-1])) - np.log((k[:-1] + 1) * (n - x - y + k[:-1] + 1))
    p = first + np.append(0.0, np.cumsum(step))
    return float((k / n * (np.log(n * k) - log(x) - log(y)) * np.exp(p)).sum())


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two labelings over what chance gives (arithmetic mean). The contingency table, of
    labels times labels, is all that comes to the driver."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).toPandas()
    n, row, col = float(cells["n"].sum()), cells.groupby("a", dropna=False)["n"].sum().to_numpy(), cells.groupby("b", dropna=False)["n"].sum().to_numpy()
    if not n:
        return df.sparkSession.createDataFrame([], "ami double")
    h = lambda x: -float((x / n * np.log(x / n)).sum())
    of_a, of_b = cells.groupby("a", dropna=False)["n"].transform("sum"), cells.groupby("b", dropna=False)["n"].transform("sum")
    mi, expected = float((cells["n"] / n * np.log(cells["n"] * n / (of_a * of_b))).sum()), 0.0
    for x in map(int, row):
        for y in map(int, col):
            expected += _chance(x, y, int(n))
    usual = (h(row) + h(col)) / 2
    ami = 1.0 if abs(usual - expected) < 1e-12 else (mi - expected) / (usual - expected)
    return df.sparkSession.createDataFrame([(ami,)], "ami double")


def silhouette(df: DataFrame, key: str, features: str = "features", sample: int = 2000) -> DataFrame:
    """(label, n, silhouette) of plain distances over a bounded sample: the ``sample`` rows of smallest hash of the key are
    held against each other, so the pairs are bounded too. Noise is left out; a label with one sampled row has 0."""
    some = df.where(F.col("label") != c.NOISE).select(key, "label", F.col(features).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.lit("silhouette"), key), key).limit(sample)
    rows = some.toPandas()
    x, label = np.array(rows["v"].tolist()).reshape(len(rows), -1), rows["label"].to_numpy()
    out = []
    if len(rows):
        d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0)) if len(rows) * len(rows) * x.shape[1] < 2e8 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        names = np.unique(label)
        sums = np.stack([d[:, label == g].sum(axis=1) for g in names], axis=1)
        size = np.array([(label == g).sum() for g in names])
        own = np.searchsorted(names, label)
        inner = sums[np.arange(len(x)), own] / np.maximum(size[own] - 1, 1)
        other = sums / size
        other[np.arange(len(x)), own] = np.inf
        outer = other.min(axis=1) if len(names) > 1 else np.zeros(len(x))
        s = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
        out = [(int(g), int((label == g).sum()), float(s[label == g].mean())) for g in names]
    return df.sparkSession.createDataFrame(out, "label int, n long, silhouette double")


def kth_distances(df: DataFrame, key: str, features: str = "features", k: int = 4, sample: int = 2000) -> DataFrame:
    """(key, distance) to the k-th nearest of all other rows, for the ``sample`` rows of smallest hash of the key. The sample
    is broadcast; tasks keep the k least distances of each before they are merged."""
    some = df.select(key, features).orderBy(F.xxhash64(F.lit("kth"), key), key).limit(sample).collect()
    ids, q = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], float).reshape(len(some), -1)

    def least(batches):
        best, norm = np.full((len(ids), k), np.inf), (q * q).sum(1)[:, None]
        for batch in batches:
            for at in range(0, len(batch) if len(ids) else 0, 512):  # a task holds the distances of this many rows
                part = batch.iloc[at : at + 512]
                x = np.array(part[features].tolist(), float)
                d = np.sqrt(np.maximum(norm + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
                d[ids[:, None] == part[key].to_numpy()[None, :]] = np.inf
                both = np.concatenate((best, d), axis=1)
                both.partition(k - 1, axis=1)
                best = both[:, :k].copy()
        which, _ = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({key: ids[which], "d": best[np.isfinite(best)]})

    rows = df.select(key, features).mapInPandas(least, f"{key} long, d double")
    order = F.row_number().over(Window.partitionBy(key).orderBy("d"))
    return rows.withColumn("_n", order).where(F.col("_n") == k).select(key, F.col("d").alias("distance"))


def dbscan_eps(df: DataFrame, key: str, features: str = "features", k: int = 4, sample: int = 2000) -> float:
    """The distance at the sharpest bend (largest second difference) of the sorted k-th distances of a bounded sample; with
    under three of them their 95 % quantile."""
    d = np.sort(kth_distances(df, key, features, k, sample).toPandas()["distance"].to_numpy())
    if not len(d):
        raise ValueError("too few rows for a k-th neighbour")
    return float(d[int(np.argmax(np.diff(d, 2))) + 2]) if len(d) > 2 else float(np.quantile(d, 0.95))


def dbscan_grid(df: DataFrame, key: str, features: str, dimensions: int, eps: list[float], min_samples: list[int]) -> DataFrame:
    """(eps, min_samples, clusters, noise_share, score) of each setting: score is the silhouette over a bounded sample, plus
    1 / (1 + Davies-Bouldin), plus Calinski-Harabasz / 1000; null with fewer than two clusters. Each is a distributed run."""
    out = []
    for e in eps:
        for m in min_samples:
            found = hierarchy.dbscan(df, key, features, e, m, dimensions).join(df.select(key, features), key)
            one = found.agg(F.countDistinct(F.when(F.col("label") != c.NOISE, F.col("label"))).alias("k"), F.avg((F.col("label") == c.NOISE).cast("double")).alias("noise")).first()
            score = None
            if one.k >= 2:
                i = c.internal_metrics(found, features).first()
                s = silhouette(found.withColumn("label", F.col("label").cast("int")), key, features, 1000).toPandas()
                score = float((s["silhouette"] * s["n"]).sum() / s["n"].sum()) + 1 / (1 + i.davies_bouldin) + i.calinski_harabasz / 1000
            out.append((float(e), int(m), int(one.k), float(one.noise or 0.0), score))
    return df.sparkSession.createDataFrame(out, "eps double, min_samples int, clusters int, noise_share double, score double")


def outlier_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, is_outlier, n, mean, median, std) of clustered and noise rows; medians are exact."""
    long = df.withColumn("is_outlier", F.col("label") == c.NOISE).select("is_outlier", *[F.col(x).cast("double").alias(x) for x in columns]).unpivot(["is_outlier"], columns, "feature", "x")
    medians = grouped_quantiles(long, ["feature", "is_outlier"], "x", [0.5]).select("feature", "is_outlier", F.col("quantiles")[0].alias("median"))
    one = long.groupBy("feature", "is_outlier").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return one.join(medians, ["feature", "is_outlier"], "left").select("feature", "is_outlier", "n", "mean", "median", "std")


def squared_silhouette(df: DataFrame, features: str = "features") -> DataFrame:
    """(label, n, silhouette) over all rows, with squared distances, whose means follow from each cluster's sums; noise is left
    out, and a label of one row has 0. The clusters' sums (labels times dimensions) are broadcast."""
    rows = df.where(F.col("label") != c.NOISE).select("label", F.col(features).cast("array<double>").alias("v"))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    sums = c.centroids(rows, "v").join(rows.groupBy("label").agg(F.avg(norm(F.col("v"))).alias("sq")), "label")
    known = sums.agg(F.collect_list(F.struct("label", "n", "centre", "sq")).alias("all"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mean = lambda k: norm(F.col("v")) - 2 * dot(F.col("v"), k.centre) + k.sq
    far = rows.crossJoin(F.broadcast(known)).withColumn("far", F.transform("all", lambda k: F.struct(k.label.alias("label"), k.n.alias("n"), F.greatest(F.lit(0.0), mean(k)).alias("d"))))
    own = F.filter("far", lambda k: k.label == F.col("label"))[0]
    a = F.try_divide(own.d * own.n, own.n - 1)
    b = F.array_min(F.transform(F.filter("far", lambda k: k.label != F.col("label")), lambda k: k.d))
    s = F.when(own.n > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    return far.select("label", s.alias("s")).groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))
