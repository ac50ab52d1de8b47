"""Per-user and per-day aggregates of transactions: each family is one groupBy over the user."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.stats import EPSILON, one_row, quantile, whole_days, z_scores

# Ticket categories, periods of analysis, kinds that move money in and out.
TICKETS = (50.0, 500.0)
PERIODS = (7, 30, 90)
MONEY_IN, MONEY_OUT = ("deposit", "bonus"), ("withdrawal", "win")
RFM_CUTS = (("champions", 444), ("loyal_customers", 334), ("potential_loyalists", 224), ("at_risk", 144))


def as_of_of(df: DataFrame, ts: str) -> DataFrame:
    """The default moment of reference: the newest timestamp, as one row."""
    return one_row(df, F.max(ts).alias("_as_of"))


def user_transaction_summary(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Completed transactions of the last days per user, with sums by kind."""
    rows = df.where((F.col("status") == "completed") & (F.col("created_at") >= F.lit(as_of) - F.expr(f"interval {days} days")))
    of = lambda kind: F.sum(F.when(F.col("transaction_type") == kind, F.col("amount")).otherwise(0.0))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_transactions"), of("deposit").alias("total_deposits"), of("withdrawal").alias("total_withdrawals"),
        of("bet").alias("total_bets"), of("win").alias("total_wins"), F.avg("amount").alias("avg_transaction_amount"),
        F.countDistinct("game_type").alias("unique_games_played"),
        F.max("created_at").alias("last_transaction_date"), F.date_trunc("day", F.max("created_at")).alias("last_activity_date"))


def daily_transaction_metrics(df: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    rows = df.where(F.col("created_at") >= F.lit(as_of) - F.expr(f"interval {days} days"))
    return rows.groupBy(F.to_date("created_at").alias("transaction_date"), "transaction_type", "status").agg(
        F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))


def daily_user_activity(df: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    rows = df.where(F.col("created_at") >= F.lit(as_of) - F.expr(f"interval {days} days"))
    return rows.groupBy(F.to_date("created_at").alias("activity_date"), F.col("transaction_type").alias("activity_type")).agg(
        F.count("*").alias("activity_count"), F.countDistinct("user_id").alias("unique_users"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_value"), F.avg("amount").alias("avg_value"))


def rfm(df: DataFrame, as_of: dt.datetime, approx: bool = False) -> DataFrame:
    """Recency in whole days, frequency and monetary value per user, quartile scores 1 to 4 and a segment. The quartile
    cuts are one row that is broadcast. Sums are taken to six places, so that the order of adding up parts none that are equal."""
    values = df.groupBy("user_id").agg(
        whole_days(F.max("created_at"), F.lit(as_of)).alias("recency_days"), F.count("created_at").alias("frequency_transactions"),
        F.round(F.sum("amount"), 6).alias("monetary_value"))
    names = {"recency": "recency_days", "frequency": "frequency_transactions", "monetary": "monetary_value"}
    cuts = one_row(values, *[quantile(c, q / 4, approx).alias(f"_{n}{q}") for n, c in names.items() for q in (1, 2, 3)])
    out = values.crossJoin(cuts)
    for n, c in names.items():
        steps = [1, 2, 3, 4] if n != "recency" else [4, 3, 2, 1]
        out = out.withColumn(f"{n}_score", F.when(F.col(c) <= F.col(f"_{n}1"), steps[0]).when(F.col(c) <= F.col(f"_{n}2"), steps[1]).when(F.col(c) <= F.col(f"_{n}3"), steps[2]).otherwise(steps[3]))
    score = F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score")
    segment = F.lit("hibernating")
    for name, low in reversed(RFM_CUTS):
        segment = F.when(F.col("rfm_score") >= low, name).otherwise(segment)
    out = out.withColumn("rfm_score", score).withColumn("rfm_segment", segment)
    return out.select("user_id", *names.values(), *[f"{n}_score" for n in names], "rfm_score", "rfm_segment")


def category_preference(df: DataFrame, column: str = "game_type") -> DataFrame:
    """Most frequent value (the smallest among ties), its rows and distinct values, and diversity = distinct / rows."""
    return df.groupBy("user_id").agg(
        F.mode(column, True).alias(f"favorite_{column}"), F.count(column).alias(f"{column}_count"),
        F.countDistinct(column).alias(f"{column}_distinct"), (F.countDistinct(column) / F.count(column)).alias(f"{column}_diversity"))


def avg_amount_by(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Mean amount per user and value as columns; a missing value is 0. Naming the values saves a pass."""
    wide = df.groupBy("user_id").pivot(column, values).agg(F.avg("amount"))
    return wide.select("user_id", *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"avg_bet_{v}") for v in values])


def period_frequency(df: DataFrame, as_of: dt.datetime, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    return df.groupBy("user_id").agg(*[F.count_if(F.col("created_at") >= F.lit(as_of) - F.expr(f"interval {p} days")).alias(f"frequency_last_{p}_days") for p in periods])


def ticket_stats(df: DataFrame) -> DataFrame:
    """Statistics of amounts, ticket category, bet volatility (0 where the mean isn't positive) and activity
    frequency = rows / (whole days between first and last + 1), 0 for one row."""
    span = whole_days(F.min("created_at"), F.max("created_at"))
    return df.groupBy("user_id").agg(
        F.avg("amount").alias("ticket_mean"), F.median("amount").alias("ticket_median"), F.stddev_samp("amount").alias("ticket_std"),
        F.min("amount").alias("ticket_min"), F.max("amount").alias("ticket_max"), F.count("amount").alias("ticket_count"), F.sum("amount").alias("ticket_sum"),
        F.when(F.avg("amount") < TICKETS[0], "baixo").when(F.avg("amount") < TICKETS[1], "medio").otherwise("alto").alias("ticket_category"),
        F.when(F.avg("amount") > 0, F.stddev_samp("amount") / F.avg("amount")).otherwise(0.0).alias("bet_volatility"),
        F.when(F.count("*") > 1, F.count("*") / (span + 1)).otherwise(0.0).alias("activity_frequency"))


def deposit_withdrawal(df: DataFrame) -> DataFrame:
    into, out = F.col("transaction_type").isin(*MONEY_IN), F.col("transaction_type").isin(*MONEY_OUT)
    d, w = F.sum(F.when(into, F.col("amount")).otherwise(0.0)), F.sum(F.when(out, F.col("amount")).otherwise(0.0))
    return df.groupBy("user_id").agg(
        d.alias("deposit_sum"), F.count_if(into).alias("deposit_count"), w.alias("withdrawal_sum"), F.count_if(out).alias("withdrawal_count"),
        (d / (w + 1)).alias("deposit_withdrawal_ratio"), (d - w).alias("net_deposits"))


def user_aggregates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample spread, minimum and maximum of each numeric column, to 4 decimals."""
    calls = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy("user_id").agg(*[F.round(f(F.col(c).cast("double")), 4).alias(f"{c}_{n}") for c in columns for n, f in calls.items()])


def transaction_stats(df: DataFrame) -> DataFrame:
    """One row: totals, range and the distribution of kinds and statuses as text ``value:n`` in order."""
    total = df.agg(F.count("*").alias("total_transactions"), F.countDistinct("user_id").alias("unique_users"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    for c in ("transaction_type", "status"):
        parts = df.groupBy(c).count().agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", c, "count"))), ",").alias(f"{c}_distribution"))
        total = total.crossJoin(F.broadcast(parts))
    return total


def table_stats(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    last = F.lit(as_of) - F.expr("interval 24 hours")
    return df.agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.count_if(F.col("created_at") >= last).alias("last_24h"))


def temporal_row_features(df: DataFrame, ts: str = "created_at") -> DataFrame:
    hour = F.hour(ts)
    return df.withColumns({
        "hour": hour, "weekday": F.weekday(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"), "month": F.month(ts), "quarter": F.quarter(ts), "day": F.dayofmonth(ts),
        "week": F.weekofyear(ts), "is_business_hours": hour.between(9, 17).cast("int"), "is_peak_hours": hour.between(19, 23).cast("int"), "period": F.when(hour <= 6, "night").when(hour <= 12, "morning").when(hour <= 18, "afternoon").otherwise("evening"),
        "time_slot": F.when(hour < 6, "madrugada").when(hour < 12, "manha").when(hour < 18, "tarde").otherwise("noite")})


def temporal_preferences(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Modal hour, weekday and slot (smallest among ties), weekend share, and all modal weekdays as a comma list."""
    rows = temporal_row_features(df, ts)
    base = rows.groupBy("user_id").agg(F.mode("hour", True).alias("preferred_hour"), F.mode("weekday", True).alias("preferred_weekday"), F.mode("time_slot", True).alias("preferred_slot"), F.avg(F.col("is_weekend").cast("double")).alias("weekend_ratio"))
    counts = rows.groupBy("user_id", "weekday").count().groupBy("user_id").agg(F.collect_list(F.struct("count", "weekday")).alias("days"))
    most = F.array_max(F.transform("days", lambda d: d["count"]))
    days = F.array_join(F.transform(F.array_sort(F.transform(F.filter("days", lambda d: d["count"] == most), lambda d: d["weekday"])), lambda x: x.cast("string")), ",")
    return base.join(counts.select("user_id", days.alias("modal_weekdays")), "user_id")


def activity_regularity(df: DataFrame, ts: str = "created_at", tie: str = "transaction_id") -> DataFrame:
    """Sample spread of the whole-day gaps between a user's events; null below three events."""
    w = Window.partitionBy("user_id").orderBy(ts, tie)
    gaps = df.select("user_id", whole_days(F.lag(ts).over(w), F.col(ts)).cast("double").alias("gap"))
    return gaps.groupBy("user_id").agg(F.stddev_samp("gap").alias("activity_regularity"), F.count("gap").alias("gaps"))


def zscore_composite(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Mean of population z-scores of the columns; null z-scores count as 0."""
    scored = z_scores(df, columns, "_z")
    mean = sum((F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    return scored.withColumn(out, mean).drop(*[f"{c}_z" for c in columns])


def encode_normalize(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """Categories as numbers in sorted order (``_encoded``), numbers as population z-scores (``_normalized``)."""
    out = df
    for c in categories:
        codes = numbered(df.select(c).where(F.col(c).isNotNull()).distinct(), F.col(c), name=f"{c}_encoded")
        out = out.join(codes, c, "left")
    return z_scores(out, numbers, "_normalized")


def variance_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance, importance): sample variances over the largest."""
    one = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    long = one.unpivot([], columns, "feature", "variance")
    return long.crossJoin(F.broadcast(long.agg(F.max("variance").alias("_m")))).select("feature", "variance", (F.col("variance") / F.col("_m")).alias("importance"))


def running_balance(df: DataFrame) -> DataFrame:
    """Balance of each user after each transaction: deposits and wins add, other kinds take."""
    w = Window.partitionBy("user_id").orderBy("created_at", "transaction_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signed = F.when(F.col("transaction_type").isin("deposit", "win"), F.col("amount")).otherwise(-F.col("amount"))
    return df.select("transaction_id", "user_id", F.sum(signed).over(w).alias("balance"))


def flag_transactions(df: DataFrame, hot: float = 1000.0, suspicious: float = 10_000.0, kyc: float = 2000.0) -> DataFrame:
    return df.select("transaction_id", "user_id", "amount", ((F.col("amount") >= hot) & (F.col("status") == "completed")).alias("is_hot"), (F.col("amount") > suspicious).alias("is_suspicious"), (F.col("amount") > kyc).alias("needs_kyc"))


def merge_sources(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with suffixes _dl and _tx. Joining on the user alone multiplies rows; a second key keeps them."""
    left = a.select(*on, *[F.col(c).alias(f"{c}_dl") for c in a.columns if c not in on])
    right = b.select(*on, *[F.col(c).alias(f"{c}_tx") for c in b.columns if c not in on])
    return left.join(right, on, "full_outer")


def features_to_long(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "feature_name", "feature_value")


def features_to_wide(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per key; of several values of a feature the newest date counts, if there is one."""
    if "calculation_date" in long.columns:
        w = Window.partitionBy(key, "feature_name").orderBy(F.desc("calculation_date"))
        long = long.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return long.groupBy(key).pivot("feature_name", names).agg(F.first("feature_value"))


def features_asof(spine: DataFrame, features: DataFrame, max_age: str, key: str = "user_id") -> DataFrame:
    """For each spine row (key, at) the latest feature row (key, ts, value) at or before it that is no older than
    max_age. Features and spine are merged in one sorted stream per key, so no pair of rows is formed."""
    merged = spine.select(key, F.col("at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("timestamp").alias("feature_ts")).unionByName(
        features.select(key, F.col("ts").alias("_t"), F.lit(0).alias("_kind"), F.col("value").cast("double").alias("value"), F.col("ts").alias("feature_ts")))
    w = Window.partitionBy(key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("feature_ts", "value")), ignorenulls=True).over(w)
    out = merged.withColumn("_last", last).where("_kind = 1")
    fresh = F.col("_last.feature_ts") >= F.col("_t") - F.expr(f"interval {max_age}")
    return out.select(key, F.col("_t").alias("at"), F.when(fresh, F.col("_last.feature_ts")).alias("feature_ts"), F.when(fresh, F.col("_last.value")).alias("value"))


def safe_share(part: str, whole: str):
    return F.col(part) / (F.col(whole) + EPSILON)
