"""Features from rows of one user or from aggregated rows, alignment of feature families, and insights over a population.

Aggregated-row variants take one row per user with the columns that they name; a column that df lacks gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.significance import p_value_r
from ..functions.stats import EPSILON, share


def _has(df: DataFrame, *names: str) -> Column:
    """The first of the columns that df has, as a double, or null."""
    found = next((n for n in names if n in df.columns), None)
    return F.col(found).cast("double") if found else F.lit(None).cast("double")


def session_stats(df: DataFrame, duration: str = "session_duration") -> DataFrame:
    """Per user mean, median, sample spread, largest and number of session lengths; nulls are left out."""
    d = F.col(duration)
    return df.groupBy("user_id").agg(F.avg(d).alias("session_mean"), F.median(d).alias("session_median"), F.stddev_samp(d).alias("session_std"), F.max(d).alias("session_max"), F.count(d).alias("session_count"))


def attach(df: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their key's aggregate; rows whose key is null or unknown get nulls."""
    return df.join(aggregate, key, "left")


def assemble_features(families: dict[str, DataFrame], key: str = "user_id") -> DataFrame:
    """One row per key of any family, columns as <family>_<name>, missing numbers 0."""
    named = [f.select(key, *[F.col(c).alias(f"{n}_{c}") for c in f.columns if c != key]) for n, f in families.items()]
    rows = reduce(lambda a, b: a.join(b, key, "full"), named)
    return rows.fillna(0, [c for c, t in rows.dtypes if c != key and t not in ("string", "boolean", "timestamp", "date")])


def frequency_trend(df: DataFrame, ts: str = "timestamp", order: str = "event_id") -> DataFrame:
    """(user_id, frequency_trend): rows a day in the second half of a user's rows against the first; null where a half
    has no span."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(ts, order))
    rows = df.select("user_id", F.col(ts).cast("double").alias("t"), (k <= F.floor(n / 2)).alias("early"))
    half = lambda early: F.count_if(F.col("early") == early) / F.nullif(F.max(F.when(F.col("early") == early, F.col("t"))) - F.min(F.when(F.col("early") == early, F.col("t"))), F.lit(0.0))
    per = rows.groupBy("user_id").agg(half(True).alias("a"), half(False).alias("b"))
    return per.select("user_id", ((F.col("b") - F.col("a")) / F.col("a")).alias("frequency_trend"))


def trend(df: DataFrame, y: Column, ts: str = "timestamp", order: str = "event_id") -> DataFrame:
    """(user_id, n, slope, mean, r2, significance) of y over the row number; significance is 1 - p of the slope, 0 where y
    is constant (its r2 is 1). Users with fewer than 3 values get 0 for slope and significance."""
    rows = df.select("user_id", y.alias("y"), F.col(ts).alias("t"), F.col(order).alias("o")).where("y is not null")
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "o")) - 1
    per = rows.withColumn("x", x.cast("double")).groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.avg("y").alias("mean"), F.regr_r2("y", "x").alias("r2"), F.when(F.regr_syy("y", "x") == 0, 0.0).otherwise(F.sqrt(F.regr_r2("y", "x"))).alias("r"))
    enough = F.col("n") >= 3
    return per.select("user_id", "n", F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"), "mean", F.when(enough, F.col("r2")).alias("r2"), F.when(enough, 1 - p_value_r(F.col("r"), F.col("n"))).otherwise(0.0).alias("significance"))


def bet_escalation(df: DataFrame) -> DataFrame:
    """(user_id, bet_escalation, escalation_significance): slope of bets over their mean."""
    return trend(df, F.col("bet_amount")).select("user_id", (F.col("slope") / (F.col("mean") + EPSILON)).alias("bet_escalation"), F.col("significance").alias("escalation_significance"))


def learning_trend(df: DataFrame, win_rate: Column) -> DataFrame:
    """(user_id, performance_improvement, improvement_consistency, improvement_significance) of users with 3 values."""
    return trend(df, win_rate).where("n >= 3").select("user_id", F.col("slope").alias("performance_improvement"), F.col("r2").alias("improvement_consistency"), F.col("significance").alias("improvement_significance"))


def store_features(df: DataFrame, as_of: Column, ts: str = "timestamp") -> DataFrame:
    """(user_id, avg_bet_7d, session_frequency, win_rate, churn_risk, ltv_prediction): real rows of the last seven days in
    place of stored values; a user without rows in them has a mean bet of 0."""
    recent = F.col(ts) > as_of - F.expr("interval 7 days")
    per = df.where(F.col(ts) <= as_of).groupBy("user_id").agg(
        F.coalesce(F.avg(F.when(recent, F.col("bet_amount"))), F.lit(0.0)).alias("avg_bet_7d"), F.count_if(recent).cast("double").alias("session_frequency"),
        share(F.col("win_amount") > 0).alias("win_rate"), ((as_of.cast("double") - F.max(ts).cast("double")) / 86400).alias("days"))
    churn = F.least(F.lit(1.0), F.col("days") / 30) * (1 - F.least(F.lit(1.0), F.col("avg_bet_7d") / 100))
    rows = per.withColumn("churn_risk", churn)
    return rows.select("user_id", "avg_bet_7d", "session_frequency", "win_rate", "churn_risk", (F.col("avg_bet_7d") * F.col("session_frequency") * 52 * (1 - F.col("churn_risk"))).alias("ltv_prediction"))


# --- aggregated rows ---------------------------------------------------------------------------------------


def financial_from_aggregates(df: DataFrame, key: str = "user_id", whale: float = 10_000, high_roller: float = 1_000) -> DataFrame:
    """Spending, bankroll, volatility, profitability and risk of rows that are aggregated already."""
    bet, most = _has(df, "avg_bet_amount", "total_bet_amount", "bet_amount", "average_bet", "total_wagered"), _has(df, "max_bet_amount")
    deposits, avg, spread = _has(df, "total_deposits", "avg_deposit", "deposit_amount"), _has(df, "avg_bet_amount", "mean_bet_amount"), _has(df, "bet_std", "bet_volatility", "std_bet_amount")
    won, wagered = _has(df, "total_won"), _has(df, "total_wagered")
    return df.select(
        key, bet.alias("avg_bet"), _has(df, "total_bet_amount").alias("total_wagered"), most.alias("max_bet"), (most / (bet + EPSILON)).alias("max_bet_ratio"),
        F.when(bet >= whale, 3).when(bet >= high_roller, 2).when(bet.isNotNull(), 1).alias("user_tier"), deposits.alias("total_deposits"),
        F.when(deposits > 0, _has(df, "avg_bet_amount") / deposits).alias("bet_sizing_ratio"), F.when(avg > 0, spread / avg).alias("normalized_volatility"),
        _has(df, "win_rate").alias("win_rate"), F.try_divide(won - wagered, wagered).alias("roi"), F.try_divide(won, wagered).alias("rtp"),
        F.least(most / (_has(df, "avg_bet_amount") + EPSILON) / 10, F.lit(1.0)).alias("risk_concentration"))


def behavior_from_aggregates(df: DataFrame, key: str = "user_id", game_ratios: tuple[str, ...] = ()) -> DataFrame:
    """Risk, consistency, engagement, diversity, learning and social features of aggregated rows; ``game_ratios`` names
    the shares of game kinds, of which those within 0 and 1 count."""
    avg, freq, win, since = _has(df, "avg_bet_amount"), _has(df, "session_frequency"), _has(df, "win_rate"), _has(df, "days_since_last_bet")
    duration, hour, bets = _has(df, "avg_session_duration"), _has(df, "preferred_hour"), _has(df, "total_bets")
    used = [F.when(F.col(c).between(0, 1), F.col(c).cast("double")).otherwise(0.0) for c in game_ratios]
    total = reduce(lambda a, b: a + b, used) if used else F.lit(0.0)
    mixed = [F.when((total > 0) & (c > 0), -c / total * F.log(c / total)).otherwise(0.0) for c in used]
    return df.select(
        key, F.when(avg > 0, _has(df, "max_bet_amount") / (avg + EPSILON)).when(avg.isNotNull(), 1.0).alias("bet_max_ratio"),
        F.when(bets > 0, _has(df, "total_amount") / bets).alias("avg_bet_normalized"), (F.abs(win - 0.5) * 2).alias("win_rate_extremity"),
        F.least(freq / 30, F.lit(2.0)).alias("session_frequency_normalized"),
        (F.least(_has(df, "total_sessions") / F.greatest(_has(df, "days_active"), F.lit(1.0)), F.lit(5.0)) / 5).alias("daily_activity_consistency"),
        F.when(duration > 0, _has(df, "avg_games_per_session") / (duration / 60)).alias("session_intensity"), (1 / (1 + since / 7)).alias("recency_score"),
        F.least(freq / 30, F.lit(1.0)).alias("frequency_score"), (F.when(total > 0, reduce(lambda a, b: a + b, mixed)) if mixed else F.lit(None).cast("double")).alias("ratio_entropy"),
        (F.abs(_has(df, "sports_bet_ratio") - 0.5) * 2).alias("specialization_score"), F.abs(win - 0.5).alias("skill_indicator"),
        F.least(F.log1p(bets) / 10, F.lit(1.0)).alias("experience_level"),
        F.when(hour.between(18, 23), 1.0).when(hour.between(0, 6), 0.0).when(hour.isNotNull(), 0.5).alias("social_timing"), _has(df, "cashback_usage").alias("promotion_engagement"))


def temporal_from_aggregates(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Circadian, weekly, cycle, timing and evolution features of rows with preferred_hour, session_frequency and
    days_since_last_bet."""
    hour, freq, since = _has(df, "preferred_hour"), _has(df, "session_frequency"), _has(df, "days_since_last_bet")
    flag = lambda c: F.when(hour.isNotNull(), c.cast("int"))
    return df.select(
        key, hour.alias("preferred_hour"), flag(hour.between(0, 6)).alias("night_activity_ratio"), flag(hour.between(18, 23)).alias("peak_hours_ratio"), flag(hour.between(7, 17)).alias("business_hours_ratio"),
        F.when((hour >= 22) | (hour <= 2), 0.7).when(hour.isNotNull(), 0.3).alias("weekend_activity_ratio"), F.least(freq / 21, F.lit(1.0)).alias("weekly_diversity"),
        (168 / F.greatest(freq, F.lit(1.0))).alias("avg_session_interval"), F.least(freq / 14, F.lit(1.0)).alias("cycle_regularity"), (1 / (1 + since / 7)).alias("cycle_activity"),
        flag(hour <= 8).alias("early_starter"), flag(hour >= 22).alias("late_finisher"), (1 / (1 + since / 30)).alias("activity_recency"),
        F.lit(0.5).alias("monthly_seasonality"), F.lit(0.25).alias("quarter_concentration"))


def temporal_insights(df: DataFrame, hour: str, weekend: str) -> DataFrame:
    """One row over users: commonest preferred hour (smallest of equals), its mean, and shares of weekend users."""
    top = df.groupBy(hour).agg(F.count("*").alias("n")).where(F.col(hour).isNotNull()).agg(F.max_by(hour, F.struct("n", -F.col(hour))).alias("most_common_hour"))
    w = F.col(weekend)
    one = df.agg(F.avg(hour).alias("mean_hour"), F.avg((w > 0.6).cast("double")).alias("weekend_heavy"), F.avg((w < 0.2).cast("double")).alias("weekday_only"), F.avg(w.between(0.4, 0.6).cast("double")).alias("balanced"))
    return top.crossJoin(one)


# Shares of channels by age, under 25, under 40 and beyond; channels without a share have 0.1.
CHANNELS_BY_AGE = ((25, {"push": 0.4, "in_app": 0.3, "email": 0.2, "sms": 0.1}), (40, {"email": 0.4, "push": 0.3, "sms": 0.2, "in_app": 0.1}), (None, {"email": 0.5, "sms": 0.3, "phone": 0.2}))


def communication_from_aggregates(df: DataFrame, key: str = "user_id", channels: tuple[str, ...] = ("email", "sms", "push", "in_app", "phone")) -> DataFrame:
    """(key, <channel>_usage_ratio, promotion_content_ratio) of rows with age and cashback_usage; without an age each channel
    has 0.1."""
    age = _has(df, "age", "user_age")

    def share_of(channel: str) -> Column:
        young, middle, old = (x.get(channel, 0.1) for _, x in CHANNELS_BY_AGE)
        return F.when(age < CHANNELS_BY_AGE[0][0], young).when(age < CHANNELS_BY_AGE[1][0], middle).when(age.isNotNull(), old).otherwise(0.1)

    return df.select(key, *[share_of(c).alias(f"{c}_usage_ratio") for c in channels], _has(df, "cashback_usage").alias("promotion_content_ratio"))


def communication_insights(df: DataFrame, rate: str, hour: str) -> DataFrame:
    """One row over users: mean response rate, shares of high (over 0.3) and low (under 0.1) responders, mean and commonest
    preferred hour (smallest of equals)."""
    r = F.col(rate)
    top = df.where(F.col(hour).isNotNull()).groupBy(hour).agg(F.count("*").alias("n")).agg(F.max_by(hour, F.struct("n", -F.col(hour))).alias("peak_hour"))
    return top.crossJoin(df.agg(F.avg(r).alias("avg_response_rate"), F.avg((r > 0.3).cast("double")).alias("highly_responsive"), F.avg((r < 0.1).cast("double")).alias("low_responsive"), F.avg(hour).alias("avg_hour")))


def consent_metrics(df: DataFrame, kind: str, given: Column) -> DataFrame:
    """(kind, total, active, withdrawn, consent_rate) per kind of request or consent; an unknown answer counts as withdrawn."""
    yes = F.coalesce(given, F.lit(False))
    return df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("total"), F.count_if(yes).alias("active"), F.count_if(~yes).alias("withdrawn"), F.avg(yes.cast("double")).alias("consent_rate"))
