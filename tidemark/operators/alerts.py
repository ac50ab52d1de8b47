"""Alerts over metrics: thresholds, health, business rules that must hold for several windows, and drift summaries.

Metric tables have a row per window and metric, whatever the rows that they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import grouped_quantiles

# Weights of the health score, and what is divided by before 1 minus it is taken.
HEALTH = {"cpu_utilization": (0.2, 1.0), "memory_utilization": (0.2, 1.0), "error_rate": (0.3, 1 / 20), "response_time_p95": (0.2, 2000.0), "queue_depth": (0.1, 1000.0)}


def metric_alerts(df: DataFrame, key: list[str], limits: dict[str, float]) -> DataFrame:
    """(key, metric, value, threshold, severity) of metrics over their limit, critical over 1.2 times; nulls raise none."""
    long = df.unpivot(key, list(limits), "metric", "value") if limits else df
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("metric")]
    rows = long.withColumn("threshold", limit).where(F.col("value") > F.col("threshold"))
    return rows.withColumn("severity", F.when(F.col("value") > F.col("threshold") * 1.2, "critical").otherwise("warning"))


def health_score() -> Column:
    """0 to 1 over the columns of HEALTH; a missing value counts as unhealthy."""
    return sum((F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col(c) / n)), F.lit(0.0)) * w for c, (w, n) in HEALTH.items()), F.lit(0.0))


def sustained(df: DataFrame, key: str, order: str, condition: Column, windows: int) -> Column:
    """Whether the condition holds in this window and the ``windows - 1`` before it, of the same key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - windows, 0)
    return (F.min(F.coalesce(condition, F.lit(False)).cast("int")).over(w) == 1) & (F.count("*").over(w) == windows)


def daily_metrics(df: DataFrame) -> DataFrame:
    """(metric, day, value) of transactions (user_id, amount, status, transaction_type, delay, created_at): failure_rate,
    delay_p95 (to 1 in 10,000 ranks), volume, rejection_rate of bets, high_value (over 500), revenue and active users."""
    day = F.to_date("created_at").alias("day")
    bet, ok = F.col("transaction_type") == "bet", F.col("status") == "completed"
    wide = df.groupBy(day).agg(
        F.avg((~ok).cast("double")).alias("failure_rate"), F.percentile_approx("delay", F.lit(0.95), F.lit(10_000)).cast("double").alias("delay_p95"), F.count("*").cast("double").alias("volume"),
        F.coalesce(F.try_divide(F.count_if(bet & ~ok), F.count_if(bet)), F.lit(0.0)).alias("rejection_rate"), F.count_if(F.col("amount") > 500).cast("double").alias("high_value"),
        F.coalesce(F.sum(F.when(ok, F.col("amount"))), F.lit(0.0)).alias("revenue"))
    # apart, since beside distinct users every sketch of delays would be one of a user's day
    users = df.select(day, "user_id").distinct().groupBy("day").agg(F.count("user_id").cast("double").alias("value"))
    rows = wide.unpivot(["day"], ["failure_rate", "delay_p95", "volume", "rejection_rate", "high_value", "revenue"], "metric", "value")
    return rows.unionByName(users.select("day", F.lit("active_users").alias("metric"), "value"))


# Rule, metric, kind of limit (over or under a value, or a multiple of the mean of the 7 days before), limit,
# windows that it must hold for, severity.
RULES = [
    ("transaction_failures", "failure_rate", "over", 0.05, 2, "critical"), ("processing_delay", "delay_p95", "over", 30.0, 2, "warning"), ("volume_spike", "volume", "over_mean", 3.0, 1, "warning"),
    ("bet_rejections", "rejection_rate", "over", 0.10, 2, "warning"), ("high_value_bets", "high_value", "over_mean", 5.0, 1, "warning"), ("revenue_drop", "revenue", "under_mean", 0.5, 1, "critical"), ("active_users_drop", "active_users", "under_mean", 0.7, 2, "warning")]


def business_alerts(metrics: DataFrame, rules: list[tuple] = RULES, at: str = "day") -> DataFrame:
    """(rule, day, value, baseline, severity) of the days on which a rule fires: its condition has held for as many windows
    as it asks for. A mean over the 7 days before needs one day at least. ``at`` names the windows (dates, or times of any size)."""
    names = ["rule", "metric", "kind", "bound", "windows", "severity"]
    table = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rules])).alias("r")
    second = F.datediff(at, F.lit("1970-01-01")).cast("long") * 86_400 if dict(metrics.dtypes)[at] == "date" else F.unix_timestamp(F.col(at).cast("timestamp"))
    before = Window.partitionBy("metric").orderBy(second).rangeBetween(-7 * 86_400, -1)
    rows = metrics.withColumn("baseline", F.avg("value").over(before)).select("*", table).where("metric = r.metric").select(at, "value", "baseline", *[F.col(f"r.{n}").alias(n) for n in names if n != "metric"])
    holds = (F.when(F.col("kind") == "over", F.col("value") > F.col("bound")).when(F.col("kind") == "under", F.col("value") < F.col("bound"))
             .when(F.col("kind") == "over_mean", F.col("value") > F.col("bound") * F.col("baseline")).otherwise(F.col("value") < F.col("bound") * F.col("baseline")))
    w = lambda n: Window.partitionBy("rule").orderBy(at).rowsBetween(1 - n, 0)
    rows = rows.withColumn("_h", F.coalesce(holds, F.lit(False)).cast("int"))
    fires = None
    for n in sorted({r[4] for r in rules}):
        one = (F.min("_h").over(w(n)) == 1) & (F.count("*").over(w(n)) == n)
        fires = F.when(F.col("windows") == n, one) if fires is None else fires.when(F.col("windows") == n, one)
    return rows.withColumn("_f", fires).where("_f").select("rule", at, "value", F.when(F.col("kind").endswith("_mean"), F.col("baseline")).alias("baseline"), "severity")


# Fixed values, as in RULES: campaigns, logins, pipelines, open cases and service levels, over windows of an hour.
SERVICE_RULES = [
    ("campaign_engagement", "engagement_rate", "under", 0.05, 1, "warning"), ("campaign_delivery", "delivery_failure_rate", "over", 0.15, 1, "critical"), ("failed_logins", "failed_logins", "over", 10.0, 1, "warning"),
    ("stale_pipeline", "hours_since_update", "over", 24.0, 1, "warning"), ("kyc_backlog", "pending", "over", 1000.0, 1, "warning"), ("sla_latency", "latency_p99", "over", 2.0, 1, "critical"),
    ("sla_availability", "availability", "under", 0.999, 1, "critical"), ("sla_throughput", "throughput", "under", 100.0, 1, "warning")]


def _windowed(ts: str, hours: int) -> Column:
    return F.window(ts, f"{hours} hours").start.alias("at")


def _every_window(df: DataFrame, hours: int) -> DataFrame:
    """Each window from the first to the last of df, whether it has rows or not."""
    ends = df.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {hours} hours"))).alias("at"))


def _long(df: DataFrame) -> DataFrame:
    return df.unpivot(["at"], [c for c in df.columns if c != "at"], "metric", "value").where("value is not null").select("metric", "at", "value")


def request_metrics(df: DataFrame, ts: str, latency: str, code: str, login: str, hours: int = 1) -> DataFrame:
    """(metric, at, value) of requests (expressions of seconds, status code and whether it is a login): exact latency_p99, availability
    (codes below 500; a null is none), and throughput and failed_logins (codes 400 to 499) a second. Windows without requests
    have rates of 0 and neither latency nor availability; rows without a time are left out."""
    rows = df.select(_windowed(ts, hours), F.expr(latency).cast("double").alias("latency"), F.expr(code).cast("int").alias("code"), F.coalesce(F.expr(login), F.lit(False)).alias("login"))
    per = rows.groupBy("at").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("code") < 500, F.lit(False)).cast("double")).alias("availability"), F.count_if(F.col("login") & F.col("code").between(400, 499)).alias("f"))
    slow = grouped_quantiles(rows, ["at"], "latency", [0.99]).select("at", F.col("quantiles")[0].alias("latency_p99"))
    rate = lambda c: F.coalesce(F.col(c) / (3600.0 * hours), F.lit(0.0)).alias({"n": "throughput", "f": "failed_logins"}[c])
    return _long(_every_window(per, hours).join(per, "at", "left").join(slow, "at", "left").select("at", "latency_p99", "availability", rate("n"), rate("f")))


def send_metrics(df: DataFrame, sent: str, engaged: str, failed: str, hours: int = 1) -> DataFrame:
    """(metric, at, value) of messages by the window in which they were sent: engagement_rate and delivery_failure_rate, of all
    that were sent; a null condition does not hold. Windows without messages have no row."""
    part = lambda c: F.avg(F.coalesce(F.expr(c), F.lit(False)).cast("double"))
    return _long(df.groupBy(_windowed(sent, hours)).agg(part(engaged).alias("engagement_rate"), part(failed).alias("delivery_failure_rate")))


def pending_metrics(df: DataFrame, opened: str, closed: str, hours: int = 1) -> DataFrame:
    """(metric, at, value): cases opened and not closed at the end of each window. A case without an opening is none, one closed
    before it was opened counts from its closing on as less. Counts by window are summed in order, one row per window."""
    known = df.where(F.col(opened).isNotNull())
    changes = known.select(_windowed(opened, hours), F.lit(1).alias("d")).unionByName(known.where(F.col(closed).isNotNull()).select(_windowed(closed, hours), F.lit(-1).alias("d")))
    per = changes.groupBy("at").agg(F.sum("d").alias("d"))
    so_far = Window.partitionBy("metric").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return _every_window(per, hours).join(per, "at", "left").withColumn("metric", F.lit("pending")).select("metric", "at", F.sum(F.coalesce("d", F.lit(0))).over(so_far).cast("double").alias("value"))


def staleness_metrics(df: DataFrame, updated: str, hours: int = 1, until: Column | None = None) -> DataFrame:
    """(metric, at, value): hours_since_update at the end of each window, from the window of the first update to that of the last (or of
    ``until``, if that is later)."""
    per = df.groupBy(_windowed(updated, hours)).agg(F.max(updated).alias("last"))
    ends = per.select("at") if until is None else per.select("at").unionByName(per.limit(1).select(F.lit(until).cast("timestamp").alias("t")).select(_windowed("t", hours)))
    so_far = Window.partitionBy("metric").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = _every_window(ends, hours).join(per, "at", "left").withColumn("metric", F.lit("hours_since_update")).withColumn("last", F.last("last", True).over(so_far))
    return rows.where("last is not null").select("metric", "at", ((F.col("at").cast("double") - F.col("last").cast("double")) / 3600 + hours).alias("value"))


def drift_summary(alerts: DataFrame, since: Column) -> DataFrame:
    """One row over alerts (detected_at, severity, drift_score, affected_features) after ``since``: numbers, mean score (0 if
    there are none) and the five features most often affected (ties by name)."""
    recent = alerts.where(F.col("detected_at") > since)
    top = recent.select(F.explode("affected_features").alias("f")).groupBy("f").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "f").limit(5)
    names = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "f"))), lambda x: x.f).alias("most_affected_features"))
    one = recent.agg(F.count("*").alias("total_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"), F.count_if(F.col("severity") == "warning").alias("warning_alerts"), F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("avg_drift_score"))
    return one.crossJoin(names)
