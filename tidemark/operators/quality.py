"""Data quality as rows (rule, severity, score, passed, detail): each family of rules is one aggregate over the table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles, grouped_quantiles
from ..functions.stats import one_row, quantile

# Weights of the six dimensions, grades.
DIMENSIONS = {"completeness": 0.25, "accuracy": 0.20, "consistency": 0.15, "timeliness": 0.15, "uniqueness": 0.15, "validity": 0.10}
GRADES = (("A", 0.95), ("B", 0.85), ("C", 0.75), ("D", 0.60))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, low in reversed(GRADES):
        out = F.when(score >= low, name).otherwise(out)
    return out


def _rows(one: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """rules: name, severity, score, passed, over the columns of a one-row frame."""
    parts = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), c.cast("double").alias("score"), p.alias("passed")) for n, s, c, p in rules])
    return one.select(F.inline(parts))


def check_completeness(df: DataFrame, columns: list[str], critical: tuple[str, ...], limit: float = 0.95) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    share = {c: F.coalesce(F.try_divide(F.col(c), F.col("_n")), F.lit(0.0)) for c in columns}
    overall = sum(share.values(), F.lit(0.0)) / len(columns)
    return _rows(one, [("completeness", "high", overall, overall >= limit)] + [(f"completeness_{c}", "critical" if c in critical else "medium", share[c], share[c] >= (1.0 if c in critical else limit)) for c in columns])


def check_primary_key(df: DataFrame, key: str) -> DataFrame:
    text = F.trim(F.col(key).cast("string"))
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count_if(text == "").alias("blanks"), F.count(key).alias("k"), F.countDistinct(key).alias("d"))
    bad = F.col("nulls") + F.col("blanks") + F.col("k") - F.col("d")
    return _rows(one, [("primary_key", "critical", 1 - F.try_divide(bad, F.col("n")), bad == 0)])


def check_freshness(df: DataFrame, ts: str, as_of: dt.datetime, limit_hours: float = 24.0) -> DataFrame:
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.max(F.col(ts).cast("timestamp").cast("double"))) / 3600
    one = df.agg(age.alias("age"))
    return _rows(one, [("freshness", "high", F.greatest(F.lit(0.0), 1 - F.col("age") / (2 * limit_hours)), F.col("age") <= limit_hours)])


def check_duplicates(df: DataFrame, keys: list[str], limit: float = 0.02) -> DataFrame:
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.count("*").alias("_e"), F.sum("_n").alias("_n"))
    one = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_e"), F.lit(0)).alias("e"), F.count("*").alias("k"))
    r = lambda c: 1 - F.try_divide(F.col(c), F.col("n"))
    return _rows(one, [("duplicates_exact", "medium", 1 - r("e"), r("e") <= limit), ("duplicates_key", "high", 1 - r("k"), r("k") <= limit)])


def check_outliers(df: DataFrame, columns: list[str], k: float = 1.5, limit: float = 0.05, approx: bool = False) -> DataFrame:
    if approx:
        bounds = one_row(df, *[quantile(c, q, True).alias(f"_{n}_{c}") for c in columns for n, q in (("a", 0.25), ("b", 0.75))])
    else:
        exact = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
        bounds = F.broadcast(df.sparkSession.range(1).select(*[F.lit(exact[c][i]).cast("double").alias(f"_{n}_{c}") for c in columns for i, n in enumerate("ab")]))
    out = lambda c: ~F.col(c).between(F.col(f"_a_{c}") - k * (F.col(f"_b_{c}") - F.col(f"_a_{c}")), F.col(f"_b_{c}") + k * (F.col(f"_b_{c}") - F.col(f"_a_{c}")))
    one = df.crossJoin(bounds).agg(*[F.try_divide(F.count_if(out(c)), F.count(c)).alias(c) for c in columns])
    return _rows(one, [(f"outliers_{c}", "medium", 1 - F.col(c), F.col(c) <= limit) for c in columns])


def check_types(df: DataFrame, expected: dict[str, str], limit: float = 1.0) -> DataFrame:
    """Type conformity by values: the share of a column's values that the expected type holds without loss (they read back
    as they were). A missing column scores 0, one of nulls 1."""
    def fits(c: str, t: str) -> Column:
        if c not in df.columns:
            return F.lit(0.0)
        value = F.expr(f"try_cast(`{c}` as {t})")
        whole = value.isNotNull()
        if t not in ("string", "boolean", "date", "timestamp"):
            whole = whole & (value.cast("double") == F.expr(f"try_cast(`{c}` as double)"))
        return F.coalesce(F.try_divide(F.count_if(whole), F.count(f"`{c}`")), F.lit(1.0))

    one = df.agg(*[fits(c, t).alias(c) for c, t in expected.items()])
    return _rows(one, [(f"type_{c}", "high", F.col(c), F.col(c) >= limit) for c in expected])


def check_business_rules(df: DataFrame, amount: str, low: float, high: float, allowed: dict[str, list[str]]) -> DataFrame:
    one = df.agg(F.try_divide(F.count_if(F.col(amount).between(low, high)), F.count("*")).alias("amount"), *[F.try_divide(F.count_if(F.col(c).isin(v)), F.count("*")).alias(c) for c, v in allowed.items()])
    return _rows(one, [("amount_range", "high", F.col("amount"), F.col("amount") == 1)] + [(f"allowed_{c}", "medium", F.col(c), F.col(c) == 1) for c in allowed])


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], limit: float = 0.99) -> DataFrame:
    one = df.agg(*[F.try_divide(F.count_if(F.col(c).between(*r)), F.count(c)).alias(c) for c, r in ranges.items()])
    return _rows(one, [(f"range_{c}", "medium", F.col(c), F.col(c) >= limit) for c in ranges])


def check_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness beyond 5, excess kurtosis beyond 10 or sample variance below 0.01 fail."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("s", F.skewness), ("k", F.kurtosis), ("v", F.var_samp))])
    bad = lambda c: (F.abs(F.col(f"s_{c}")) > 5).cast("int") + (F.abs(F.col(f"k_{c}")) > 10).cast("int") + (F.col(f"v_{c}") < 0.01).cast("int")
    return _rows(one, [(f"distribution_{c}", "low", 1 - bad(c) / 3, bad(c) == 0) for c in columns])


def check_correlation(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.abs(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _rows(one, [(f"correlation_{a}_{b}", "low", 1 - F.col(f"c{i}"), F.col(f"c{i}") <= limit) for i, (a, b) in enumerate(pairs)])


def check_ml_readiness(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """At least 5 features, 10 rows in the smallest class, 1 % distinct values and a range of at most 1000 spreads."""
    n = F.count("*")
    one = df.agg(n.alias("n"), *[F.try_divide(F.countDistinct(c), n).alias(f"u_{c}") for c in features], *[F.try_divide(F.max(c) - F.min(c), F.stddev_samp(c)).alias(f"r_{c}") for c in features])
    one = one.crossJoin(F.broadcast(df.groupBy(label).count().agg(F.min("count").alias("least"))))
    rules = [("ml_features", "high", F.lit(min(1.0, len(features) / 5)), F.lit(len(features) >= 5)), ("ml_classes", "high", F.least(F.lit(1.0), F.col("least") / 10), F.col("least") >= 10)]
    return _rows(one, rules + [(f"ml_{c}", "medium", F.least(F.lit(1.0), F.col(f"u_{c}") / 0.01), (F.col(f"u_{c}") >= 0.01) & (F.col(f"r_{c}") <= 1000)) for c in features])


def run_suite(rules: list[DataFrame]) -> DataFrame:
    """One row over rule rows: weighted score (over the sum of weights), grade, failed critical rules and verdict."""
    rows = rules[0]
    for r in rules[1:]:
        rows = rows.unionByName(r)
    weight = F.when(F.col("severity") == "critical", 4.0).when(F.col("severity") == "high", 3.0).when(F.col("severity") == "medium", 2.0).otherwise(1.0)
    one = rows.withColumn("w", weight).agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("overall_score"), F.count("*").alias("rules"), F.count_if("passed").alias("passed_rules"), F.count_if((F.col("severity") == "critical") & ~F.col("passed")).alias("critical_issues"))
    return one.withColumn("grade", grade(F.col("overall_score"))).withColumn("passed", (F.col("critical_issues") == 0) & (F.col("overall_score") >= 0.75))


def quality_dimensions(df: DataFrame, as_of: dt.datetime, columns: list[str], key: str, ts: str, amount: str, limit_hours: float = 24.0) -> DataFrame:
    """Six dimensions in 0 to 1, their weighted score and grade, in one aggregate."""
    n = F.count("*")
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.max(F.col(ts).cast("timestamp").cast("double"))) / 3600
    one = df.agg(
        (sum((F.count(c) for c in columns), F.lit(0)) / (n * len(columns))).alias("completeness"), F.try_divide(F.count_if(F.col(amount) >= 0), n).alias("accuracy"),
        F.try_divide(F.count_if(F.col(ts) <= F.lit(as_of)), n).alias("consistency"), F.greatest(F.lit(0.0), 1 - age / (2 * limit_hours)).alias("timeliness"),
        F.try_divide(F.countDistinct(key), n).alias("uniqueness"), F.try_divide(F.count_if(F.col(key).isNotNull() & F.col(amount).isNotNull()), n).alias("validity"))
    score = sum((F.col(d) * w for d, w in DIMENSIONS.items()), F.lit(0.0))
    return one.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def volume_anomaly(df: DataFrame, baseline: float, low: float = 0.8, high: float = 2.0) -> DataFrame:
    one = df.agg(F.count("*").alias("rows")).withColumn("ratio", F.col("rows") / F.lit(baseline))
    return one.withColumn("anomaly", F.when(F.col("ratio") < low, "low").when(F.col("ratio") > high, "high").otherwise("none"))


def schema_drift(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, kind, severity, filled): expected columns that are missing or hold nothing but nulls (critical), and extra ones
    that hold values (medium), with the number of values."""
    one = df.agg(F.lit(0).alias("_none"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    seen = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`") if c in df.columns else F.lit(0)).cast("long").alias("filled"), F.lit(c in expected).alias("known"), F.lit(c in df.columns).alias("there")) for c in dict.fromkeys([*expected, *df.columns])])
    rows = one.select(F.inline(seen))
    kind = F.when(F.col("known") & ~F.col("there"), "missing").when(F.col("known") & (F.col("filled") == 0), "empty").when(~F.col("known") & (F.col("filled") > 0), "extra")
    return rows.withColumn("kind", kind).where("kind is not null").select("column", "kind", F.when(F.col("kind") == "extra", "medium").otherwise("critical").alias("severity"), "filled")


def quality_alerts(metrics: DataFrame, threshold: float = 0.9, cooldown_minutes: int = 15) -> DataFrame:
    """Alerts of metrics (dimension, ts, score) below the threshold, critical below 0.7 and high below 0.85 of it. Of
    one dimension and severity, an alert silences those of the next minutes. The choice is greedy in time, so the distinct
    times of each key pass through a task in order, of which only the last alert is held."""
    low = metrics.where(F.col("score") < threshold).withColumn("severity", F.when(F.col("score") < 0.7 * threshold, "critical").when(F.col("score") < 0.85 * threshold, "high").otherwise("medium"))
    def pass_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0.0
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (dimension, severity, at) in enumerate(batch.itertuples(index=False)):
                if (dimension, severity) != key or at - last >= cooldown_minutes * 60:
                    key, last, keep[i] = (dimension, severity), at, True
            yield batch[keep]

    times = low.select("dimension", "severity", F.col("ts").cast("double").alias("at")).distinct()
    ordered = times.repartition("dimension", "severity").sortWithinPartitions("dimension", "severity", "at")
    return ordered.mapInPandas(pass_on, times.schema).select("dimension", "severity", F.timestamp_seconds("at").alias("ts"))


def quality_baseline(history: DataFrame, last: int = 100) -> DataFrame:
    """Mean and spread of volume and score over the last checks (ts, volume, score) of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("ts"))
    rows = history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return rows.groupBy("source").agg(F.count("*").alias("checks"), F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("std_volume"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"))


def extract_quality(df: DataFrame, amount: str = "amount", key: str = "user_id") -> DataFrame:
    one = df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(F.col(amount) < 0).alias("negative"), F.count_if(F.col(amount).isNull()).alias("null_amounts"))
    issues = (F.col("null_keys") > 0).cast("int") + (F.col("negative") > 0).cast("int") + (F.col("null_amounts") > 0).cast("int")
    return one.withColumn("status", F.when(F.col("rows") == 0, "critical").when(issues == 0, "good").when(issues == 1, "warnings").otherwise("critical"))


def drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, drift, severity, null_drift): shift of the mean in three reference spreads, at most 1; over 0.3 counts."""
    def stats(df, s):
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
        return long.groupBy("feature").agg(F.avg("v").alias(f"m{s}"), F.stddev_samp("v").alias(f"s{s}"), F.avg(F.col("v").isNull().cast("double")).alias(f"n{s}"))

    both = stats(reference, 0).join(stats(current, 1), "feature")
    d = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.abs(F.col("m1") - F.col("m0")), F.col("s0")) / 3), F.lit(0.0))
    return both.select("feature", d.alias("drift"), F.when(d > 0.7, "critical").when(d > 0.5, "high").when(d > 0.3, "medium").otherwise("none").alias("severity"), (F.col("n1") - F.col("n0") > 0.1).alias("null_drift"))


def hourly_alerts(df: DataFrame, factor: float = 3.0, days: int = 7) -> DataFrame:
    """Hours (ts, value) whose volume is over ``factor`` times the mean hour of the days before: a baseline over a range
    of time. Hours are few, whatever the rows."""
    hours = df.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    w = Window.orderBy(F.col("hour").cast("long")).rangeBetween(-days * 86400, -1)
    rows = hours.withColumns({"baseline": F.avg("n").over(w), "seen": F.count("*").over(w)})
    return rows.select("hour", "n", "baseline", ((F.col("seen") > 0) & (F.col("n") > factor * F.col("baseline"))).alias("alert"))


def failure_alerts(df: DataFrame, limit: float = 0.05, windows: int = 2) -> DataFrame:
    """Days whose share of failed rows is over the limit, firing when that holds for ``windows`` days in a row."""
    days = df.groupBy(F.to_date("created_at").alias("day")).agg(F.avg((F.col("status") == "failed").cast("double")).alias("rate"))
    w = Window.orderBy("day").rowsBetween(1 - windows, 0)  # a row per day
    over = F.min((F.col("rate") > limit).cast("int")).over(w)
    return days.withColumn("firing", (over == 1) & (F.count("*").over(w) == windows))


def adaptive_threshold(df: DataFrame, column: str, limit: float, k: float = 2.0) -> DataFrame:
    return df.agg(F.least(F.avg(column) + k * F.stddev_samp(column), F.lit(2 * limit)).alias("threshold"))


def dominant_error(df: DataFrame, column: str, limit: float = 0.7) -> DataFrame:
    """(value, n, share, dominant) per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(one_row(counts, F.sum("n").alias("_t"))).select(column, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("n") / F.col("_t") > limit).alias("dominant"))


def latency_summary(df: DataFrame, key: str, column: str, failed: str, ts: str) -> DataFrame:
    """Mean, 95 % and 99 % quantiles (linear interpolation, exact at any size of a key), share of failed requests, and requests a
    second per key."""
    span = F.max(F.col(ts).cast("double")) - F.min(F.col(ts).cast("double"))
    one = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.avg(F.coalesce(F.expr(failed), F.lit(False)).cast("double")).alias("error_rate"), F.try_divide(F.count("*"), span).alias("throughput"))
    q = grouped_quantiles(df, [key], column, [0.95, 0.99]).select(F.col(key).alias("_k"), "quantiles")
    return one.join(q, one[key].eqNullSafe(q["_k"]), "left").select(key, "n", "mean", F.get("quantiles", F.lit(0)).alias("p95"), F.get("quantiles", F.lit(1)).alias("p99"), "error_rate", "throughput")


def metrics_summary(df: DataFrame, ts: str, name: str, value: str, minutes: int = 5) -> DataFrame:
    w = F.window(ts, f"{minutes} minutes")
    return df.groupBy(name, w.start.alias("start")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def retention_violations(df: DataFrame, ts: str, policy: DataFrame, category: str, as_of: dt.datetime) -> DataFrame:
    """Rows per category older than the days that the policy (category, days) allows."""
    rows = df.join(F.broadcast(policy), category)
    return rows.groupBy(category).agg(F.count("*").alias("rows"), F.count_if(F.col(ts) < F.lit(as_of) - F.make_dt_interval(F.col("days"))).alias("violations"))


def erase_subjects(df: DataFrame, ids: DataFrame, key: str, retained: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without the subjects (but those where the column ``retained`` holds), and an audit row of counts."""
    mine = ids.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    rows = df.join(mine, key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    stays = F.coalesce(F.col(retained), F.lit(False)) if retained else F.lit(False)
    audit = rows.agg(F.count_if(F.col("_gone") & ~stays).alias("erased"), F.count_if(F.col("_gone") & stays).alias("retained"), F.count_if(~F.col("_gone")).alias("others"))
    return rows.where(~F.col("_gone") | stays).drop("_gone"), audit
