"""User segments and the campaign and cluster summaries that read them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import share, whole_days
from ..functions.order import numbered

# The rules of the segments.
HIGH = {"total_deposits": 1000, "ltv": 2500, "bet_frequency": 5, "churn_risk": 0.3}
MEDIUM = {"total_deposits": 200, "ltv": 500, "bet_frequency": 2, "churn_risk": 0.6}
NEW_DAYS, NEW_DEPOSITS = 30, 100
INACTIVE_DAYS, INACTIVE_SCORE = 30, 20
NEVER_ACTIVE = 999
SEGMENTS = ("high_value", "medium_value", "low_value", "new_user", "inactive")


def churn_risk(days: Column, frequency: Column, ltv: Column, win_rate: Column, mode: str = "corrected") -> Column:
    """Weighted sum of inactivity, low frequency, low value and low win rate, in 0 to 1. ``as_written`` gives the last
    three negative weights, so that it can't exceed 0.4."""
    if mode not in ("corrected", "as_written"):
        raise ValueError(f"mode {mode!r}")
    sign = 1 if mode == "corrected" else -1
    short = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - c))
    score = F.least(F.lit(1.0), days / 30) * 0.4 + sign * (short(frequency / 10) * 0.3 + short(ltv / 1000) * 0.2 + short(win_rate / 100) * 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def segment_features(users: DataFrame, as_of: dt.datetime, mode: str = "corrected") -> DataFrame:
    """Features of each user at ``as_of``. Without activity the days are 999 and the score 0."""
    at = F.lit(as_of)
    days = F.coalesce(whole_days(F.col("last_activity"), at), F.lit(NEVER_ACTIVE))
    age = whole_days(F.col("registration_date"), at)
    ltv = F.col("total_deposits") - F.col("total_withdrawals")
    frequency = F.when(age > 0, F.col("bet_count") / age).otherwise(0.0)
    win = F.coalesce("win_rate", F.lit(0.0))
    return users.select(
        "id", F.coalesce("total_deposits", F.lit(0.0)).alias("total_deposits"), F.coalesce("total_bets", F.lit(0.0)).alias("total_bets"), win.alias("win_rate"), frequency.alias("bet_frequency"),
        F.when(F.col("bet_count") > 0, F.col("total_bets") / F.col("bet_count")).otherwise(0.0).alias("avg_bet_size"), days.alias("days_since_last_activity"), age.alias("registration_days"),
        ltv.alias("ltv"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - days * 3.33)).alias("activity_score"), churn_risk(days, frequency, ltv, win, mode).alias("churn_risk"))


def rule_segment(features: DataFrame) -> DataFrame:
    """Segment and confidence: inactive, new_user, high, medium, else low value."""
    def meets(rule):
        parts = [F.col(c) <= x if c == "churn_risk" else F.col(c) >= x for c, x in rule.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    inactive = (F.col("days_since_last_activity") >= INACTIVE_DAYS) | (F.col("activity_score") <= INACTIVE_SCORE)
    new = (F.col("registration_days") <= NEW_DAYS) & (F.col("total_deposits") <= NEW_DEPOSITS)
    pick = lambda a, b, c, d, e: F.when(inactive, a).when(new, b).when(meets(HIGH), c).when(meets(MEDIUM), d).otherwise(e)
    return features.withColumn("segment", pick("inactive", "new_user", "high_value", "medium_value", "low_value")).withColumn("confidence", pick(0.9, 0.85, 0.95, 0.8, 0.7))


def segment_recommendations(segmented: DataFrame) -> DataFrame:
    """(id, action, priority): what each segment's rules advise; a high churn risk (over 0.7) adds retention."""
    advice = {"high_value": [("vip_program", "high"), ("exclusive_bonus", "high")], "medium_value": [("deposit_bonus", "medium"), ("loyalty_points", "medium")],
              "low_value": [("free_spins", "low")], "new_user": [("welcome_bonus", "high"), ("tutorial", "medium")], "inactive": [("reactivation_offer", "high")]}
    row = lambda a, p: F.struct(F.lit(a).alias("action"), F.lit(p).alias("priority"))
    table = F.create_map(*[x for k, v in advice.items() for x in (F.lit(k), F.array(*[row(*y) for y in v]))])
    risk = F.when(F.col("churn_risk") > 0.7, F.array(row("retention_contact", "urgent"))).otherwise(F.array().cast("array<struct<action:string,priority:string>>"))
    return segmented.select("id", F.inline(F.concat(table[F.col("segment")], risk)))


def behavior_predictions(features: DataFrame) -> DataFrame:
    """Loyalty (age, frequency and activity in equal shares), chance of a next deposit and a value forecast."""
    loyalty = (F.least(F.lit(1.0), F.col("registration_days") / 365) + F.least(F.lit(1.0), F.col("bet_frequency") / 10) + F.col("activity_score") / 100) / 3 * 100
    return features.select("id", loyalty.alias("loyalty_score"), ((1 - F.col("churn_risk")) * F.least(F.lit(1.0), F.col("bet_frequency") / 5)).alias("next_deposit_probability"), (F.col("ltv") * 1.2).alias("predicted_ltv"))


def activity_score_bucket(days: Column) -> Column:
    return F.when(days < 7, 100).when(days < 30, 70).when(days < 90, 40).otherwise(10)


def behavior_levels(users: DataFrame, as_of: dt.datetime) -> DataFrame:
    days = whole_days(F.col("last_activity"), F.lit(as_of))
    return users.select(
        "id", activity_score_bucket(days).alias("activity_bucket"), F.when(days < 7, 80).when(days < 30, 60).otherwise(30).alias("activity_level"),
        F.when(F.col("bet_count") > 12, "high").when(F.col("bet_count") > 6, "medium").otherwise("low").alias("engagement_level"))


def segment_summary(users: DataFrame, as_of: dt.datetime, key: str = "segment") -> DataFrame:
    recent = lambda d: F.count_if(F.col("last_activity") > F.lit(as_of) - F.expr(f"interval {d} days"))
    return users.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("user_count"), F.avg("total_deposits").alias("avg_deposits"), F.avg("total_bets").alias("avg_bets"), F.avg("win_rate").alias("avg_win_rate"),
        recent(7).alias("active_7d"), recent(30).alias("active_30d"))


def cluster_performance(clusters: DataFrame, users: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Measures per cluster; clusters without users stay, with nulls and zeros."""
    return clusters.join(segment_summary(users, as_of, "cluster_id"), "cluster_id", "left").fillna(0, ["user_count", "active_7d", "active_30d"])


def segment_statistics(segmented: DataFrame) -> DataFrame:
    """One row: users, and per segment count, percentage and mean lifetime value."""
    is_ = lambda s: F.col("segment") == s
    return segmented.agg(F.count("*").alias("total_users"), *[e for s in SEGMENTS for e in (
        F.count_if(is_(s)).alias(f"{s}_count"), (share(is_(s)) * 100).alias(f"{s}_percentage"), F.coalesce(F.avg(F.when(is_(s), F.col("ltv"))), F.lit(0.0)).alias(f"{s}_avg_ltv"))])


def compare_clusters(performance: DataFrame, ids: list[int], metrics: list[str]) -> DataFrame:
    """(cluster_id, metric, value, rank) of two to five clusters; the largest value ranks first."""
    if not 2 <= len(ids) <= 5:
        raise ValueError("two to five clusters")
    long = performance.where(F.col("cluster_id").isin(ids)).select("cluster_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["cluster_id"], metrics, "metric", "value")
    return long.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("value"))))


def active_users_with_clusters(users: DataFrame, clusters: DataFrame) -> DataFrame:
    """Users with their current cluster, if they have one."""
    now = clusters.where("is_current").select(F.col("user_id").alias("id"), "cluster_name", "churn_risk")
    return users.join(now, "id", "left").select("id", "name", "cluster_name", "churn_risk")


def high_risk_users(users: DataFrame, clusters: DataFrame, as_of: dt.datetime, value: float = 100.0) -> DataFrame:
    """Users of some value that are at risk or silent for 14 days, with whole days of silence."""
    now = clusters.where("is_current").select(F.col("user_id").alias("id"), "churn_risk")
    rows = users.join(now, "id").where(((F.col("churn_risk") > 0.7) | (F.col("last_activity") < F.lit(as_of) - F.expr("interval 14 days"))) & (F.col("total_deposits") > value))
    out = rows.select("id", "churn_risk", whole_days(F.col("last_activity"), F.lit(as_of)).alias("days_inactive"))
    return out.orderBy(F.desc("churn_risk"), F.desc("days_inactive"), "id")


def data_health(users: DataFrame, tx: DataFrame) -> DataFrame:
    """(metric, value, status) rows."""
    rows = [
        users.agg(F.lit("users").alias("metric"), F.count("*").alias("value")),
        tx.agg(F.lit("transactions").alias("metric"), F.count("*").alias("value")),
        tx.agg(F.lit("transactions_without_user").alias("metric"), F.count_if(F.col("user_id").isNull()).alias("value")),
        tx.agg(F.lit("failed_transactions").alias("metric"), F.count_if(F.col("status") == "failed").alias("value"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    bad = F.col("metric").isin("transactions_without_user", "failed_transactions")
    return out.withColumn("status", F.when(bad, F.when(F.col("value") == 0, "ok").otherwise("warning")).otherwise(F.when(F.col("value") > 0, "ok").otherwise("critical")))


def campaign_performance(campaigns: DataFrame, results: DataFrame) -> DataFrame:
    """Funnel per campaign; rates in percent to 2 decimals, 0 where nothing came before."""
    counts = results.groupBy("campaign_id").agg(
        F.count("*").alias("total_sent"), F.count("opened_at").alias("total_opened"), F.count("clicked_at").alias("total_clicked"), F.count("converted_at").alias("total_converted"),
        F.sum(F.when(F.col("converted_at").isNotNull(), F.col("conversion_value"))).alias("total_revenue"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 100, F.col(b)), F.lit(0.0)), 2)
    out = campaigns.join(counts, "campaign_id", "left").fillna(0, ["total_sent", "total_opened", "total_clicked", "total_converted", "total_revenue"])
    return out.withColumns({"open_rate": rate("total_opened", "total_sent"), "click_rate": rate("total_clicked", "total_opened"), "conversion_rate": rate("total_converted", "total_clicked")})


def attribute_conversions(sends: DataFrame, tx: DataFrame, days: int = 7) -> DataFrame:
    """Last-touch attribution: for each transaction (user_id, tx_id, at, value) the newest send to that user within the
    days before it. Sends and transactions are one stream per user in time order, so no pairs are formed."""
    both = sends.select("user_id", F.col("sent_at").alias("_t"), F.lit(0).alias("_k"), "campaign_id", F.lit(None).cast("long").alias("tx_id"), F.lit(None).cast("double").alias("value")).unionByName(
        tx.select("user_id", F.col("at").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("campaign_id"), "tx_id", "value"))
    w = Window.partitionBy("user_id").orderBy("_t", "_k", "campaign_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_k") == 0, F.struct("_t", "campaign_id")), True).over(w)
    out = both.withColumn("_s", last).where("_k = 1")
    near = F.col("_s._t") >= F.col("_t") - F.expr(f"interval {days} days")
    return out.select("tx_id", "user_id", "value", F.when(near, F.col("_s.campaign_id")).alias("campaign_id"))


def scd2_apply(history: DataFrame, new: DataFrame, as_of: dt.datetime) -> DataFrame:
    """History (user_id, cluster_id, valid_from, valid_to, is_current) after new (user_id, cluster_id): changed users'
    current rows end at as_of and new ones begin; users that are not in ``new`` stay."""
    at = F.lit(as_of)
    n = new.select("user_id", F.col("cluster_id").alias("_new"))
    joined = history.join(n, "user_id", "left").withColumn("_ends", F.col("is_current") & F.col("_new").isNotNull() & ~F.col("cluster_id").eqNullSafe(F.col("_new")))
    kept = joined.select("user_id", "cluster_id", "valid_from", F.when(F.col("_ends"), at).otherwise(F.col("valid_to")).alias("valid_to"), (F.col("is_current") & ~F.col("_ends")).alias("is_current"))
    current = history.where("is_current").select("user_id", F.col("cluster_id").alias("_old"), F.lit(True).alias("_had"))
    begun = n.join(current, "user_id", "left").where("_had is null or not _old <=> _new").select("user_id", F.col("_new").alias("cluster_id"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))
    return kept.unionByName(begun)


def scd2_as_of(history: DataFrame, at: dt.datetime) -> DataFrame:
    return history.where((F.col("valid_from") <= F.lit(at)) & (F.col("valid_to").isNull() | (F.lit(at) < F.col("valid_to"))))


def matching_users(users: DataFrame, name: str | None = None, segment: str | None = None, cluster: int | None = None) -> DataFrame:
    rows = users.where(F.col("name").ilike(f"%{name}%")) if name else users
    rows = rows.where(F.col("segment") == segment) if segment else rows
    return rows.where(F.col("cluster_id") == cluster) if cluster is not None else rows


def search_facets(users: DataFrame, **filters) -> DataFrame:
    """(facet, value, n): how many users match in all, by segment and by cluster."""
    rows = matching_users(users, **filters).select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), x.cast("string").alias("value")) for f, x in (("total", F.lit("all")), ("segment", F.col("segment")), ("cluster", F.col("cluster_id")))])).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def search_users(users: DataFrame, name: str | None = None, segment: str | None = None, page: int = 1, limit: int = 20, cluster: int | None = None) -> DataFrame:
    """A page of users, newest activity first; ``search_facets`` has the total."""
    rows = matching_users(users, name, segment, cluster)
    return rows.orderBy(F.desc("last_activity"), "id").offset((page - 1) * limit).limit(limit)


def table_view(df: DataFrame, term: str, columns: list[str], filters: dict[str, str] | None = None, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Rows in which any of the columns holds the term and each filtered column its own, without regard to case, in the
    order of a column (nulls last)."""
    rows = df.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(term.lower()))
    for c, x in (filters or {}).items():
        rows = rows.where(F.lower(F.col(c).cast("string")).contains(x.lower()))
    return rows.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()) if sort else rows


def users_by_cluster(users: DataFrame, cluster: int, page: int, limit: int, as_of: dt.datetime) -> DataFrame:
    days = whole_days(F.col("last_activity"), F.lit(as_of))
    rows = users.where(F.col("cluster_id") == cluster).select("id", "name", (F.col("total_deposits") - F.col("total_withdrawals")).alias("ltv"), activity_score_bucket(days).alias("activity_score"))
    return rows.orderBy(F.desc("ltv"), "id").offset((page - 1) * limit).limit(limit)


def top_k(df: DataFrame, key: str, measure: str, k: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.sum(measure).alias(measure)).orderBy(F.desc(measure), key).limit(k)


def top_k_per(df: DataFrame, part: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("rank") <= k)


def systematic_sample(df: DataFrame, key: str, step: int) -> DataFrame:
    """Every step-th row in the order of the key, which must be unique, beginning with the first."""
    return numbered(df, F.col(key)).where(F.col("place") % step == 0).drop("place")


def split(df: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """A stable split by the key: validation has the fraction."""
    return df.withColumn("is_validation", F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1000 < int(fraction * 1000))


def ab_assign(df: DataFrame, key: str, split_percent: int = 50) -> DataFrame:
    """Variant b if md5(key) mod 100 is below the split, folded digit by digit since md5 has 128 bits."""
    bucket = F.expr(f"aggregate(filter(split(md5(cast(`{key}` as binary)), ''), d -> d != ''), 0, (a, d) -> (a * 16 + cast(conv(d, 16, 10) as int)) % 100)")
    return df.withColumn("bucket", bucket).withColumn("variant", F.when(F.col("bucket") < split_percent, "b").otherwise("a"))


def ab_results(df: DataFrame, minimum: int = 100) -> DataFrame:
    """One row over (variant, converted): rates, relative lift of b over a, two-proportion z and the winner."""
    n = lambda v: F.count_if(F.col("variant") == v)
    c = lambda v: F.count_if((F.col("variant") == v) & F.col("converted"))
    one = df.agg(n("a").alias("n_a"), n("b").alias("n_b"), c("a").alias("c_a"), c("b").alias("c_b"))
    ra, rb = F.try_divide(F.col("c_a"), F.col("n_a")), F.try_divide(F.col("c_b"), F.col("n_b"))
    pooled = F.try_divide(F.col("c_a") + F.col("c_b"), F.col("n_a") + F.col("n_b"))
    z = F.try_divide(rb - ra, F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n_a")) + F.try_divide(F.lit(1.0), F.col("n_b")))))
    enough = (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum)
    return one.select("n_a", "n_b", ra.alias("rate_a"), rb.alias("rate_b"), F.try_divide(rb - ra, ra).alias("relative_lift"), z.alias("z"), F.when(~enough, "insufficient").when(rb > ra, "b").when(ra > rb, "a").otherwise("tie").alias("winner"))


def frequency_cap(sends: DataFrame, per_day: int = 3, per_week: int = 2) -> DataFrame:
    """Whether each send (user_id, sent_at, send_id) stays within the caps, counting those of the day and week before;
    times count to the nearest second."""
    w = lambda s: Window.partitionBy("user_id").orderBy(F.rint(F.col("sent_at").cast("double")).cast("long")).rangeBetween(-s, 0)
    rows = sends.withColumns({"day_count": F.count("*").over(w(86400)), "week_count": F.count("*").over(w(7 * 86400))})
    return rows.withColumn("allowed", (F.col("day_count") <= per_day) & (F.col("week_count") <= per_week))


def campaign_forecast(scores: DataFrame, cost: float = 1.0) -> DataFrame:
    """Per segment over (segment, conversion_probability, value): expected conversions, revenue, cost and ROI."""
    return scores.groupBy("segment").agg(
        F.count("*").alias("targeted"), F.sum("conversion_probability").alias("expected_conversions"), F.sum(F.col("conversion_probability") * F.col("value")).alias("expected_revenue"), (F.count("*") * F.lit(cost)).alias("cost"),
    ).withColumn("roi", (F.col("expected_revenue") - F.col("cost")) / F.col("cost"))


def changed_since(df: DataFrame, column: str, since: dt.datetime) -> DataFrame:
    return df.where(F.col(column) > F.lit(since))
