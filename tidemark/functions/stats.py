"""Statistics as column expressions. Spreads say whether they are of a sample or a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps denominators from zero.
EPSILON = 1e-8


def ratio(a: Column, b: Column) -> Column:
    """a / (b + EPSILON)."""
    return a / (b + F.lit(EPSILON))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: infinite where only b is 0, NaN where both are; null only where a part is null."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def share(condition: Column) -> Column:
    """Share of rows of a group for which the condition holds; nulls count as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def quantile(c: Column | str, q: float, approx: bool = False) -> Column:
    """Linear-interpolated quantile. ``approx`` bounds memory per group, for global quantiles of large tables."""
    return F.percentile_approx(c, F.lit(q), F.lit(10_000)) if approx else F.percentile(c, F.lit(q))


def coefficient_of_variation(c: Column | str) -> Column:
    return ratio(F.stddev_samp(c), F.avg(c))


def whole_days(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours."""
    return F.floor((end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")) / 86400).cast("long")


def shares(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """(key, value, n, p): how often each value occurs in its group, as a count and a share. Nulls are left out."""
    keys = [key] if isinstance(key, str) else key
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(total, keys).withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def entropy(p: Column | str) -> Column:
    """Natural-log entropy of a group of shares."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.sum(p * F.log(p))


def one_row(df: DataFrame, *aggs: Column) -> DataFrame:
    """Global statistics, one broadcast row; a window without partitions would run in one task."""
    return F.broadcast(df.agg(*aggs))


def z_scores(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """Population z-scores as new columns; zero spread gives 0, nulls stay null."""
    stats = one_row(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(stats)
    for c in columns:
        s = F.col(f"_s_{c}")
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_m_{c}")) / F.when(s > 0, s).otherwise(F.lit(1.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])
