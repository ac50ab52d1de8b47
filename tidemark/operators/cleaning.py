"""Cleaning steps. Each returns rows; ``clean`` chains them and counts what every step removed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.order import exact_quantiles, modes
from ..functions.stats import one_row, quantile
from ..sources.shared import written

# What fills missing fields.
UNKNOWN_COLUMNS = ("game_type", "channel", "status")


def require_key(df: DataFrame, key: str = "user_id") -> DataFrame:
    if key not in df.columns:
        raise ValueError(f"column {key} is required")
    return df.dropna(subset=[key])


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_key(df: DataFrame, keys: list[str], newest: list) -> DataFrame:
    """The first row of each key in the order ``newest``, which should end with a column that breaks ties."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fill_missing(df: DataFrame, as_of: dt.datetime, amounts: tuple[str, ...] = ("amount",), skip: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Nulls become ``unknown`` in known categories, the column's mode in other strings, 0 in amounts, the median in
    other numbers and as_of in timestamps. Modes (the smallest of equals) and medians are exact at any size."""
    kinds = {c: t for c, t in df.dtypes if c not in skip}
    texts = [c for c, t in kinds.items() if t == "string" and c not in UNKNOWN_COLUMNS]
    medians = [c for c, t in kinds.items() if t in ("double", "float", "int", "bigint") and c not in amounts]
    middle = exact_quantiles(df, {c: [0.5] for c in medians}) if medians else {}
    fill = {c: F.lit("unknown") for c in UNKNOWN_COLUMNS if c in kinds} | {c: F.lit(0.0) for c in amounts if c in kinds}
    fill |= {c: F.lit(x).cast("string") for c, x in modes(df, texts).items()} | {c: F.lit(x[0]).cast(kinds[c]) for c, x in middle.items()}
    fill |= {c: F.lit(as_of).cast(t) for c, t in kinds.items() if t.startswith("timestamp")}
    return df.select(*[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c) for c in df.columns])


def standardize_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Emails in lower case, phones as digits and plus, categories in lower case with underscores, others cleaned."""
    rule = {"email": text.email, "phone": text.phone, "game_type": text.category, "channel": text.category, "currency": text.currency}
    return df.withColumns({c: rule.get(c, text.standardize)(F.col(c)) for c in columns})


def coerce_types(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Columns cast to types; what can't be cast is null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in spec.items() if c in df.columns})


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5, approx: bool = False) -> DataFrame:
    if not approx:
        exact = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
        return F.broadcast(df.sparkSession.range(1).select(*[e for c, (a, b) in exact.items() for e in (F.lit(None if a is None else a - k * (b - a)).cast("double").alias(f"_lo_{c}"), F.lit(None if a is None else b + k * (b - a)).cast("double").alias(f"_hi_{c}"))]))
    q = [(quantile(c, 0.25, True), quantile(c, 0.75, True)) for c in columns]
    return one_row(df, *[e for c, (a, b) in zip(columns, q, strict=True) for e in ((a - k * (b - a)).alias(f"_lo_{c}"), (b + k * (b - a)).alias(f"_hi_{c}"))])


def filter_iqr(df: DataFrame, columns: list[str], k: float = 1.5, approx: bool = False) -> DataFrame:
    """Rows whose values lie within k interquartile ranges of the quartiles; nulls stay."""
    out = df.crossJoin(iqr_bounds(df, columns, k, approx))
    for c in columns:
        out = out.where(F.col(c).isNull() | F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
    return out.select(*df.columns)


def filter_zscore(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Rows within ``limit`` population spreads of the mean; nulls and columns without spread stay."""
    out = df.crossJoin(one_row(df, *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]))
    for c in columns:
        out = out.where(F.col(c).isNull() | (F.abs(F.col(c) - F.col(f"_m_{c}")) <= limit * F.col(f"_s_{c}")))
    return out.select(*df.columns)


def handle_outliers(df: DataFrame, columns: list[str], k: float = 1.5, limit: float = 3.0) -> DataFrame:
    """Column after column, rows outside the quartile range or the z-score go; each bound sees the rows that are left.
    A row outside either goes."""
    for c in columns:
        a, b = exact_quantiles(df, {c: [0.25, 0.75]})[c]
        rows = df.crossJoin(one_row(df, F.lit(a).cast("double").alias("_a"), F.lit(b).cast("double").alias("_b"), F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s")))
        inside = F.col(c).between(F.col("_a") - k * (F.col("_b") - F.col("_a")), F.col("_b") + k * (F.col("_b") - F.col("_a"))) & (F.abs(F.col(c) - F.col("_m")) <= limit * F.col("_s"))
        df = rows.where(F.col(c).isNull() | inside).select(*df.columns)
    return df


def filter_amount(df: DataFrame, low: float = 0.01, high: float = 100_000.0, column: str = "amount") -> DataFrame:
    return df.where(F.col(column).between(low, high))


def validate_email(df: DataFrame, column: str = "email") -> DataFrame:
    return df.withColumn(column, F.when(text.valid_email(F.col(column)), F.col(column)).otherwise("invalid@unknown.com"))


def validate_phone(df: DataFrame, column: str = "phone") -> DataFrame:
    return df.withColumn(column, F.when(text.valid_phone(F.col(column)), F.col(column)).otherwise("unknown"))


def filter_dates(df: DataFrame, as_of: dt.datetime, column: str = "created_at", first: dt.datetime = dt.datetime(2020, 1, 1)) -> DataFrame:
    return df.where(F.col(column).between(F.lit(first), F.lit(as_of) + F.expr("interval 1 day")))


def filter_active_users(df: DataFrame, min_rows: int, key: str = "user_id") -> DataFrame:
    """Rows of users with at least so many rows; the counts are aggregated before they meet the rows."""
    return df.join(df.groupBy(key).count().where(F.col("count") >= min_rows).select(key), key, "left_semi")


def filter_recent(df: DataFrame, as_of: dt.datetime, days: int = 90, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(as_of) - F.expr(f"interval {days} days"))


def clean(df: DataFrame, as_of: dt.datetime, keys: tuple[str, ...] = ("user_id", "created_at"), tie: str = "transaction_id") -> tuple[DataFrame, DataFrame]:
    """Cleaned rows and a report (step, rows, removed) of one row per step. Each step that shuffles or needs statistics of
    all rows is a table, from which the next one and the report go on, so that nothing runs twice."""
    steps = [("input", df), ("key", require_key(df))]
    steps.append(("exact_duplicates", written(dedup_exact(steps[-1][1]), "clean")))
    steps.append(("key_duplicates", written(dedup_key(steps[-1][1], list(keys), [F.col(tie).desc()]), "clean")))
    steps.append(("missing", written(fill_missing(steps[-1][1], as_of), "clean")))
    steps.append(("amounts", filter_amount(steps[-1][1])))
    steps.append(("dates", filter_dates(steps[-1][1], as_of)))
    steps.append(("outliers", written(handle_outliers(steps[-1][1], ["amount"]), "clean")))
    counts = None
    for i, (name, rows) in enumerate(steps):
        one = rows.agg(F.lit(i).alias("place"), F.lit(name).alias("step"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionAll(one)
    w = Window.orderBy("place")  # a row per step
    report = counts.withColumn("removed", F.coalesce(F.lag("rows").over(w) - F.col("rows"), F.lit(0)))
    return steps[-1][1], report.select("step", "rows", "removed")


def clean_quality(cleaned: DataFrame, report: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: completeness, retention, errors and the quality score of a cleaning: 0.3 completeness, 0.3 retention, 0.2 less a
    tenth for each error, 0.2 less the share of duplicates that were removed; 0 without rows."""
    filled = cleaned.agg(F.count("*").alias("n"), sum((F.count(f"`{c}`") for c in cleaned.columns), F.lit(0)).alias("filled"))
    of = lambda step, c: F.max(F.when(F.col("step") == step, F.col(c)))
    one = report.agg(of("input", "rows").alias("before"), of("outliers", "rows").alias("after"), F.sum(F.when(F.col("step").isin("exact_duplicates", "key_duplicates"), F.col("removed"))).alias("duplicates")).crossJoin(F.broadcast(filled))
    complete, kept = F.try_divide(F.col("filled"), F.col("n") * len(cleaned.columns)), F.try_divide(F.col("after"), F.col("before"))
    rows = one.select(F.coalesce(complete, F.lit(0.0)).alias("completeness"), F.coalesce(kept, F.lit(0.0)).alias("retention"), "duplicates", "before", "n").withColumn("errors", (F.col("completeness") < least).cast("int"))
    score = F.col("completeness") * 0.3 + F.col("retention") * 0.3 + F.greatest(F.lit(0.0), 1 - F.col("errors") / 10) * 0.2 + (1 - F.least(F.lit(1.0), F.col("duplicates") / F.greatest("before", F.lit(1)))) * 0.2
    return rows.select("completeness", "retention", "errors", F.when(F.col("n") > 0, score).otherwise(0.0).alias("quality_score"))


def validate_cleaned(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of nulls, share of key duplicates, number of issues and whether at most two."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)) / (F.count("*") * len(df.columns))
    out = df.agg(F.count("*").alias("rows"), nulls.alias("null_share"), (1 - F.countDistinct(F.struct(*keys)) / F.count("*")).alias("duplicate_share"))
    return out.withColumn("issues", (F.col("null_share") > 0.05).cast("int") + (F.col("duplicate_share") > 0.02).cast("int") + (F.col("rows") == 0).cast("int")).withColumn("valid", F.col("issues") <= 2)


def ml_ready(df: DataFrame, key: str = "user_id", drop: tuple[str, ...] = (), unique: float = 0.95) -> DataFrame:
    """One row per key without technical columns and strings that are nearly all distinct; numeric nulls are 0."""
    rows = df.drop(*drop).dropDuplicates([key])
    strings = [c for c, t in rows.dtypes if t == "string" and c != key]
    if strings:
        n = rows.count()
        rows = rows.drop(*[c for c in strings if n and rows.where(F.col(c).isNotNull()).select(c).distinct().count() / n > unique])
    return rows.fillna(0)
