"""Clustering with pyspark.ml, density clustering on a grid, and evaluation by aggregates over (id, label, vector)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles, grouped_quantiles
from ..functions.stats import one_row

NOISE = -1


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def prepare_matrix(df: DataFrame, key: str, columns: list[str], scaler: str = "standard", least: int = 10) -> DataFrame:
    """(key, features): median fill and scaling; columns without spread go. Raises below ``least`` rows."""
    if scaler not in ("standard", "minmax", "robust"):
        raise ValueError(f"scaler {scaler!r}")
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])).alias(c) for c in columns])
    calls = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c)), "robust": (F.avg, F.stddev_pop)}[scaler]
    stats = filled.agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in zip("ms", calls, strict=True)]).first().asDict()
    if stats["rows"] < least:
        raise ValueError(f"at least {least} rows are needed")
    if scaler == "robust":
        for c, (low, middle, high) in exact_quantiles(filled, {c: [0.25, 0.5, 0.75] for c in columns}).items():
            stats |= {f"m_{c}": middle, f"s_{c}": None if middle is None else high - low}
    used = [c for c in columns if stats[f"s_{c}"]]
    return filled.select(key, F.array(*[(F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in used]).alias("features"))


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 42):
    """A fitted model and the rows with label and distance to their centre."""
    rows = df.withColumn("_v", array_to_vector(features))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="label").fit(rows)
    return model, assign_clusters(model, df, features)


def assign_clusters(model, df: DataFrame, features: str = "features") -> DataFrame:
    """New rows with label, distance to the centre and confidence 1 / (1 + distance)."""
    rows = model.transform(df.withColumn("_v", array_to_vector(features)))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    d = F.sqrt(squared_distance(F.col(features).cast("array<double>"), centres[F.col("label")]))
    return rows.drop("_v").withColumn("distance", d).withColumn("confidence", 1 / (1 + d))


def kmeans_auto(df: DataFrame, ks: range, features: str = "features", seed: int = 42) -> tuple[int, DataFrame]:
    """The k of most votes (largest second difference of cost 2, silhouette 2, Davies-Bouldin 1, Calinski-Harabasz 1)
    and the measures per k. Each k is a distributed fit; only measures come to the driver."""
    rows = df.cache()
    found = []
    for k in ks:
        model, labelled = kmeans(rows, k, features, seed)
        m = internal_metrics(labelled, features).first()
        silhouette = ClusteringEvaluator(featuresCol="_v", predictionCol="label").evaluate(labelled.withColumn("_v", array_to_vector(features)))
        found.append((k, float(model.summary.trainingCost), float(silhouette), m.davies_bouldin, m.calinski_harabasz))
    rows.unpersist()
    votes = dict.fromkeys(ks, 0)
    bends = {found[i][0]: found[i - 1][1] - 2 * found[i][1] + found[i + 1][1] for i in range(1, len(found) - 1)}
    votes[max(bends, key=bends.get) if bends else found[0][0]] += 2
    votes[max(found, key=lambda x: x[2])[0]] += 2
    votes[min(found, key=lambda x: x[3])[0]] += 1
    votes[max(found, key=lambda x: x[4])[0]] += 1
    table = df.sparkSession.createDataFrame(found, "k int, cost double, silhouette double, davies_bouldin double, calinski_harabasz double")
    return max(votes, key=lambda k: (votes[k], -k)), table


def project_2d(df: DataFrame, features: str = "features", k: int = 2) -> DataFrame:
    rows = df.withColumn("_v", array_to_vector(features))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    return model.transform(rows).withColumn("projected", vector_to_array("_p")).drop("_v", "_p")


def _long(df: DataFrame, features: str, *keep: str) -> DataFrame:
    return df.select(*keep, "label", F.posexplode(F.col(features).cast("array<double>")).alias("dim", "x"))


def centroids(df: DataFrame, features: str = "features") -> DataFrame:
    """(label, n, centre) from partial sums per dimension."""
    sums = _long(df.where(F.col("label") != NOISE), features).groupBy("label", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("centre"))


def internal_metrics(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz, exact from sums of distances to centres; noise is left out. Pairs
    of centres are few, so they cross."""
    c = centroids(df, features)
    rows = df.where(F.col("label") != NOISE).join(F.broadcast(c), "label").withColumn("d2", squared_distance(F.col(features).cast("array<double>"), F.col("centre")))
    per = rows.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w")).join(c, "label")
    right = per.select(F.col("label").alias("l2"), F.col("s").alias("s2"), F.col("centre").alias("c2"))
    worst = per.crossJoin(F.broadcast(right)).where("label <> l2").groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.sqrt(squared_distance(F.col("centre"), F.col("c2")))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    mean = _long(df.where(F.col("label") != NOISE), features).groupBy("dim").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("mean"))
    ch = per.crossJoin(F.broadcast(mean)).agg(F.sum(F.col("n") * squared_distance(F.col("centre"), F.col("mean"))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return db.crossJoin(ch).select("davies_bouldin", (F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), F.col("k").alias("clusters"))


def compactness_separation(df: DataFrame, features: str = "features") -> DataFrame:
    """Mean distance to the own centre, mean distance between centres, and separation over compactness."""
    c = centroids(df, features)
    inner = df.join(F.broadcast(c), "label").agg(F.avg(F.sqrt(squared_distance(F.col(features).cast("array<double>"), F.col("centre")))).alias("compactness"))
    other = c.select(F.col("label").alias("l2"), F.col("centre").alias("c2"))
    apart = c.crossJoin(F.broadcast(other)).where("label < l2").agg(F.avg(F.sqrt(squared_distance(F.col("centre"), F.col("c2")))).alias("separation"))
    return inner.crossJoin(apart).withColumn("ratio", F.col("separation") / F.col("compactness"))


def external_metrics(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information, homogeneity, completeness and V of two labelings,
    from their contingency table."""
    cell = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    row, col = cell.groupBy("a").agg(F.sum("n").alias("ra")), cell.groupBy("b").agg(F.sum("n").alias("cb"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = cell.agg(F.sum("n").cast("double").alias("t"), F.sum(pairs("n")).alias("ij"))
    h = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    ra = row.crossJoin(F.broadcast(total.select("t"))).agg(F.sum(pairs("ra")).alias("pa"), h("ra").alias("ha"))
    cb = col.crossJoin(F.broadcast(total.select("t"))).agg(F.sum(pairs("cb")).alias("pb"), h("cb").alias("hb"))
    mi = cell.join(row, "a").join(col, "b").crossJoin(F.broadcast(total.select("t"))).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"))
    one = total.crossJoin(ra).crossJoin(cb).crossJoin(mi)
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    hom, com = F.coalesce(F.try_divide(F.col("mi"), F.col("ha")), F.lit(1.0)), F.coalesce(F.try_divide(F.col("mi"), F.col("hb")), F.lit(1.0))
    return one.select(((F.col("ij") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("ari"), (F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"), hom.alias("homogeneity"), com.alias("completeness"), (2 * hom * com / (hom + com)).alias("v_measure"))


def cluster_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(label, feature, size, percentage, mean, median, std, min, max, is_noise)."""
    sizes = df.groupBy("label").agg(F.count("*").alias("size"))
    sizes = sizes.crossJoin(one_row(df, F.count("*").alias("_n"))).select("label", "size", (F.col("size") * 100 / F.col("_n")).alias("percentage"))
    long = df.select("label", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["label"], columns, "feature", "x")
    stats = long.groupBy("label", "feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    medians = grouped_quantiles(long, ["label", "feature"], "x", [0.5]).select("label", "feature", F.col("quantiles")[0].alias("median"))
    stats = stats.join(medians, ["label", "feature"], "left").select("label", "feature", "mean", "median", "std", "min", "max")
    return stats.join(F.broadcast(sizes), "label").withColumn("is_noise", F.col("label") == NOISE)


def cluster_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, importance): population variance of the clusters' means over that of the rows."""
    long = df.select("label", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["label"], columns, "feature", "x")
    means = long.groupBy("feature", "label").agg(F.avg("x").alias("m")).groupBy("feature").agg(F.var_pop("m").alias("b"))
    return long.groupBy("feature").agg(F.var_pop("x").alias("t")).join(means, "feature").select("feature", F.try_divide("b", "t").alias("importance"))


def business_separation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, f, eta_squared): one-way analysis of variance of each measure over the labels, from group sums."""
    long = df.select("label", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["label"], columns, "feature", "x")
    g = long.groupBy("feature", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("w"))
    t = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"), F.sum("w").alias("within"), F.sum("n").alias("rows"), F.count("*").alias("k"))
    b = g.join(t, "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("between"))
    return t.join(b, "feature").select("feature", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("rows") - F.col("k")))).alias("f"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"))


def outlier_analysis(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, inside, outside, difference, effect): means of clustered and noise rows and Cohen's d."""
    long = df.withColumn("o", F.col("label") == NOISE).select("o", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["o"], columns, "feature", "x")
    of = lambda f, o: f(F.when(F.col("o") == o, F.col("x")))
    one = long.groupBy("feature").agg(of(F.avg, False).alias("inside"), of(F.avg, True).alias("outside"), of(F.var_samp, False).alias("v0"), of(F.var_samp, True).alias("v1"))
    d = F.col("outside") - F.col("inside")
    return one.select("feature", "inside", "outside", d.alias("difference"), F.try_divide(d, F.sqrt((F.col("v0") + F.col("v1")) / 2)).alias("effect"))


def differentiators(df: DataFrame, columns: list[str]) -> DataFrame:
    """(label, feature, deviation): measures whose cluster mean is over one spread from the overall mean."""
    long = df.select("label", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["label"], columns, "feature", "x")
    total = long.groupBy("feature").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    rows = long.groupBy("label", "feature").agg(F.avg("x").alias("m")).join(F.broadcast(total), "feature")
    return rows.select("label", "feature", F.try_divide(F.col("m") - F.col("mu"), F.col("sd")).alias("deviation")).where(F.abs("deviation") > 1)


def archetype(profile: DataFrame) -> DataFrame:
    """Archetype of each row with avg_bet, frequency, volatility and response_rate."""
    a, f, v, r = (F.col(c) for c in ("avg_bet", "frequency", "volatility", "response_rate"))
    return profile.withColumn("archetype", F.when(a > 100, F.when(v > 1.5, "High Roller Risk Taker").otherwise("VIP Conservative Player")).when(a > 50, F.when(f > 0.7, "Regular Engaged Player").otherwise("Moderate Occasional Player")).when(f > 0.8, "Frequent Small Bettor").when(r > 0.3, "Promotion-Responsive Player").when(v < 0.5, "Cautious Conservative Player").otherwise("Casual Gaming Enthusiast"))


def cross_cluster(personas: DataFrame) -> DataFrame:
    """One row over (size, value, risk): balance of sizes, concentration of value (Herfindahl) and size-weighted risk."""
    t = one_row(personas, F.sum("value").alias("_v"), F.sum("size").alias("_s"))
    return personas.crossJoin(t).agg((1 - F.stddev_samp("size") / F.avg("size")).alias("balance"), F.sum(F.pow(F.col("value") / F.col("_v"), 2)).alias("value_concentration"), F.sum(F.col("risk") * F.col("size") / F.col("_s")).alias("weighted_risk"))


def _offsets(dimensions: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(dimensions):
        out = [(*o, x) for o in out for x in (-1, 0, 1)]
    return out


def align_labels(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """b's labels renamed to those of a that they overlap most with (ties to the smaller); noise stays."""
    table = a.select(key, F.col("label").alias("la")).join(b.select(key, "label"), key).where(f"la <> {NOISE} and label <> {NOISE}").groupBy("label", "la").count()
    best = table.groupBy("label").agg(F.max_by("la", F.struct("count", -F.col("la"))).alias("to"))
    return b.join(F.broadcast(best), "label", "left").select(key, F.coalesce("to", "label").alias("label"))


def ensemble_vote(labelings: list[DataFrame], weights: list[float], key: str, threshold: float = 0.6) -> DataFrame:
    """(key, label, agreement): the label of most weight among labelings aligned to the first, if it reaches the
    threshold, else noise."""
    total = sum(weights)
    rows = None
    for x, w in zip(labelings, weights, strict=True):
        one = (x if rows is None else align_labels(labelings[0], x, key)).select(key, "label", F.lit(w / total).alias("w"))
        rows = one if rows is None else rows.unionByName(one)
    votes = rows.groupBy(key, "label").agg(F.sum("w").alias("w"))
    best = votes.groupBy(key).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("l"), F.max("w").alias("agreement"))
    return best.select(key, F.when(F.col("agreement") >= threshold - 1e-9, F.col("l")).otherwise(NOISE).alias("label"), "agreement")


def ensemble_stability(votes: DataFrame) -> DataFrame:
    """Agreement per label: mean, median, least, and shares of stable (over 0.8) and unstable (under 0.5) rows."""
    a = F.col("agreement")
    medians = grouped_quantiles(votes, ["label"], "agreement", [0.5]).select("label", F.col("quantiles")[0].alias("median"))
    one = votes.groupBy("label").agg(F.count("*").alias("n"), F.avg(a).alias("mean"), F.min(a).alias("least"), F.avg((a > 0.8).cast("double")).alias("stable"), F.avg((a < 0.5).cast("double")).alias("unstable"))
    return one.join(medians, "label", "left").select("label", "n", "mean", "median", "least", "stable", "unstable")


def cluster_sizes(df: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("size"), "label")  # a row per cluster
    return df.groupBy("label").agg(F.count("*").alias("size")).withColumn("rank", F.row_number().over(w))
