"""Rates, health of services and models, sampling for plots, and dependencies between features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles, neighbourhoods
from ..functions.stats import coefficient_of_variation, one_row
from ..sources.shared import written


def rate_by(df: DataFrame, key: str, ts: str, condition: str, size: str = "1 day") -> DataFrame:
    """(key, start, n, rate): share of rows per key and window for which the condition holds."""
    return df.groupBy(key, F.window(ts, size).start.alias("start")).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.expr(condition), F.lit(False)).cast("double")).alias("rate"))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns become the column's exact median, those of other columns the commonest value (smallest of
    equals); a column of nulls becomes 0 or stays null."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
    medians = exact_quantiles(df, {c: [0.5] for c in numeric}) if numeric else {}
    rows = df
    for c in (x for x in columns if x not in numeric):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.count("*").alias("n"))
        rows = rows.crossJoin(F.broadcast(counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias(f"_fill_{c}"))))
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double"), F.lit(0.0)) if c in numeric else F.coalesce(F.col(c), F.col(f"_fill_{c}"))
    return rows.select(*[fill(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def importance_sample(df: DataFrame, key: str, x: str, y: str, n: int, order: str) -> DataFrame:
    """The n rows of most importance: 0.3 distance to the centre plus 0.7 deviation from the mean of the ten rows
    around in the order of all rows."""
    c = one_row(df, F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    far = lambda a, b: F.sqrt(F.pow(F.col(x) - a, 2) + F.pow(F.col(y) - b, 2))
    rows = neighbourhoods(df.select(key, order, x, y), [F.col(order), F.col(key)], {"_a": F.col(x), "_b": F.col(y)}, 5).crossJoin(c)
    rows = rows.select(key, F.round(0.3 * far(F.col("_x"), F.col("_y")) + 0.7 * far(F.col("_a"), F.col("_b")), 6).alias("importance"))
    return rows.orderBy(F.desc("importance"), key).limit(n)


def timing(df: DataFrame) -> DataFrame:
    """Per user: spread of mean durations by hour, the hour of the longest mean (smallest among ties), and the rank
    correlation of hour and mean bet (average ranks)."""
    hours = df.groupBy("user_id", F.hour("timestamp").alias("h")).agg(F.round(F.avg("session_duration"), 9).alias("d"), F.round(F.avg("bet_amount"), 9).alias("b"))
    rank = lambda c: F.rank().over(Window.partitionBy("user_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("user_id", c)) - 1) / 2
    rows = hours.withColumn("rh", rank("h")).withColumn("rb", rank("b"))
    return rows.groupBy("user_id").agg(coefficient_of_variation("d").alias("duration_by_hour_cv"), F.max_by("h", F.struct("d", -F.col("h"))).alias("best_hour"), F.corr("rh", "rb").alias("hour_bet_correlation"))


def model_health(df: DataFrame, key: str, ts: str, failed: str, latency: str, minutes: int = 60, succeeded: str | None = None) -> DataFrame:
    """(key, start, requests, error_rate, mean_latency, status): errors over 5 % are unhealthy, a mean latency over 1 s
    is degraded, success below 95 % a warning. What has not failed has succeeded, unless ``succeeded`` says it."""
    ok = F.expr(succeeded) if succeeded else ~F.expr(failed)
    rows = df.groupBy(key, F.window(ts, f"{minutes} minutes").start.alias("start")).agg(F.count("*").alias("requests"), F.avg(F.expr(failed).cast("double")).alias("error_rate"), F.avg(latency).alias("mean_latency"), F.avg(ok.cast("double")).alias("_ok"))
    return rows.withColumn("status", F.when(F.col("error_rate") > 0.05, "unhealthy").when(F.col("mean_latency") > 1.0, "degraded").when(F.col("_ok") < 0.95, "warning").otherwise("healthy")).drop("_ok")


def lineage(edges: DataFrame) -> DataFrame:
    """(feature, dependents, depth, impact) over edges (feature, depends_on): how many features depend on each, over
    any number of steps, the longest shortest path, and the impact level. Known steps double each round: a pair whose
    shortest path is longer than them passes a feature that is just so many steps from its base. A round's new pairs are a
    table in the shared folder. Cycles end, since a pair is kept once."""
    step = edges.select(F.col("depends_on").alias("base"), "feature").distinct()
    found, known = written(step.withColumn("depth", F.lit(1)), "lineage"), 1
    while not (ends := found.where(F.col("depth") == known).select("base", F.col("feature").alias("via"))).isEmpty():
        further = ends.join(found.withColumnRenamed("base", "via"), "via").groupBy("base", "feature").agg((F.min("depth") + known).alias("depth"))
        new = written(further.join(found, ["base", "feature"], "left_anti"), "lineage")
        found, known = found.unionByName(new), 2 * known
    per = found.groupBy(F.col("base").alias("feature")).agg(F.count("*").alias("dependents"), F.max("depth").alias("depth"))
    return per.withColumn("impact", F.when(F.col("dependents") > 10, "high").when(F.col("dependents") > 5, "medium").otherwise("low"))


def definition_versions(definitions: DataFrame, query: str = "query", logic: str = "logic") -> DataFrame:
    """Adds ``version``, eight digits that change with a feature's query or the logic of its transformation. Nulls count as
    empty texts."""
    return definitions.withColumn("version", F.substring(F.sha2(F.concat(F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(logic), F.lit(""))), 256), 1, 8))
