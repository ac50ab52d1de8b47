"""Queries of alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import alerts as ops
from . import views as v
from .registry import query

_METRICS = """, hm as (select channel, date_trunc('hour', timestamp) as hour, avg(engagement_score) as cpu_utilization, avg(case when responded = 1 then 0.2 else 0.8 end) as memory_utilization, avg(case when interaction_type = 'support_ticket' then 1.0 else 0.0 end) / 10 as error_rate, max(delay_hours) * 50 as response_time_p95, count(*) * 100.0 as queue_depth from inter group by 1, 2)"""
_LIMITS = {"cpu_utilization": 0.6, "memory_utilization": 0.75, "error_rate": 0.05, "response_time_p95": 2000.0, "queue_depth": 500.0}


def _metrics(spark, sf):
    return v.interactions(spark, sf).groupBy("channel", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.avg("engagement_score").alias("cpu_utilization"), F.avg(F.when(F.col("responded") == 1, 0.2).otherwise(0.8)).alias("memory_utilization"), (F.avg((F.col("interaction_type") == "support_ticket").cast("double")) / 10).alias("error_rate"),
        (F.max("delay_hours") * 50).alias("response_time_p95"), (F.count("*") * 100.0).alias("queue_depth"))


@query(_METRICS + ", u as (" + " union all ".join(f"select channel, hour, '{m}' as metric, {m}::double as value, {x}::double as threshold from hm" for m, x in _LIMITS.items()) + ") select *, case when value > threshold * 1.2 then 'critical' else 'warning' end as severity from u where value > threshold", (v.INTER,), "value threshold")
def metric_alerts(spark, sf):
    rows = _metrics(spark, sf).withColumn("queue_depth", F.col("queue_depth").cast("double"))
    return ops.metric_alerts(rows, ["channel", "hour"], _LIMITS).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(_METRICS + """ select channel, hour, 0.2 * greatest(0, 1 - cpu_utilization) + 0.2 * greatest(0, 1 - memory_utilization) + 0.3 * greatest(0, 1 - least(1, error_rate * 20)) + 0.2 * greatest(0, 1 - least(1, response_time_p95 / 2000)) + 0.1 * greatest(0, 1 - least(1, queue_depth / 1000)) as health from hm""", (v.INTER,), "health")
def health_score(spark, sf):
    return _metrics(spark, sf).select("channel", F.col("hour").cast("timestamp_ntz").alias("hour"), ops.health_score().alias("health"))


_DAYS = """, ty as (select *, transaction_id % 45 + 0.0::double as delay from tx), w as (select cast(created_at as date) as day, avg(case when status <> 'completed' then 1.0 else 0.0 end) as failure_rate, quantile_disc(delay, 0.95) as delay_p95, count(*)::double as volume, coalesce(count(*) filter (where transaction_type = 'bet' and status <> 'completed') / nullif(count(*) filter (where transaction_type = 'bet'), 0), 0) as rejection_rate,
count(*) filter (where amount > 500)::double as high_value, coalesce(sum(amount) filter (where status = 'completed'), 0) as revenue, count(distinct user_id)::double as active_users from ty group by 1), me as (""" + " union all ".join(f"select '{m}' as metric, day, {m}::double as value from w" for m in ("failure_rate", "delay_p95", "volume", "rejection_rate", "high_value", "revenue", "active_users")) + """),
mb as (select *, avg(value) over (partition by metric order by day range between interval 7 days preceding and interval 1 day preceding) as baseline from me)"""
_CONDITIONS = {"over": "value > {x}", "over_mean": "value > {x} * baseline", "under_mean": "value < {x} * baseline"}
_FIRED = ", ru as (" + " union all ".join(f"select '{r}' as rule, day, value, {'baseline' if k.endswith('mean') else 'null'} as baseline, '{s}' as severity, coalesce(min(cast(coalesce({_CONDITIONS[k].format(x=x)}, false) as int)) over (order by day rows between {n - 1} preceding and current row), 0) = 1 and count(*) over (order by day rows between {n - 1} preceding and current row) = {n} as f from mb where metric = '{m}'" for r, m, k, x, n, s in ops.RULES) + ")"


def _tx(spark, sf):
    return v.transactions(spark, sf).withColumn("delay", F.col("transaction_id") % 45 + F.lit(0.0))


@query(_DAYS + " select * from me", (v.TX,), "value")
def daily_metrics(spark, sf):
    return ops.daily_metrics(_tx(spark, sf))


@query(_DAYS + _FIRED + " select rule, day, value, baseline::double as baseline, severity from ru where f", (v.TX,), "value baseline")
def business_alerts(spark, sf):
    return ops.business_alerts(ops.daily_metrics(_tx(spark, sf)))


@query(""", a as (select created_at as detected_at, case when amount > 150 then 'critical' when amount > 80 then 'warning' else 'info' end as severity, amount / 1000 as drift_score, [game_type, device] as af from tx where created_at > timestamp '2024-01-20'), t as (select f, count(*) as n from (select unnest(af) as f from a) group by 1 order by n desc, f limit 5)
select count(*) as total_alerts, count(*) filter (where severity = 'critical') as critical_alerts, count(*) filter (where severity = 'warning') as warning_alerts, coalesce(avg(drift_score), 0) as avg_drift_score, (select string_agg(f, ',' order by n desc, f) from t) as most_affected_features from a""", (v.TX,), "avg_drift_score")
def drift_summary(spark, sf):
    rows = v.transactions(spark, sf).select(F.col("created_at").alias("detected_at"), F.when(F.col("amount") > 150, "critical").when(F.col("amount") > 80, "warning").otherwise("info").alias("severity"), (F.col("amount") / 1000).alias("drift_score"), F.array("game_type", "device").alias("affected_features"))
    return ops.drift_summary(rows, F.lit(dt.datetime(2024, 1, 20))).withColumn("most_affected_features", F.array_join("most_affected_features", ","))


# what the stored tables have fewer of than a live service
_BOUNDS = {"failed_logins": 0.0005, "stale_pipeline": 3.0, "sla_throughput": 0.003, "campaign_engagement": 0.4, "campaign_delivery": 0.3}
_SERVICE = [(r, m, k, _BOUNDS.get(r, x), n, s) for r, m, k, x, n, s in ops.SERVICE_RULES]
_CODE = "case when interaction_type = 'support_ticket' and engagement_score > 0.9 then 503 when interaction_type = 'reactive' and engagement_score < 0.3 then 401 else 200 end"
_SERVICES = f""", rq as (select time_bucket(interval 1 hour, timestamp) as start, delay_hours / 20 as latency, {_CODE} as code, channel = 'phone' as login from inter),
rp as (select start, count(*) as n, avg(case when code < 500 then 1.0 else 0.0 end) as availability, count(*) filter (where login and code between 400 and 499) as f, quantile_cont(latency, 0.99) as latency_p99 from rq group by 1),
rg as (select unnest(generate_series(min(start), max(start), interval 1 hour)) as start from rp), rw as (select start, availability, latency_p99, coalesce(n / 3600, 0) as throughput, coalesce(f / 3600, 0) as failed_logins from rg left join rp using (start)),
sd as (select sent_at::timestamp as start, avg(case when opened_at is not null then 1.0 else 0.0 end) as engagement_rate, avg(case when opened_at is null and conversion_value < 30000 then 1.0 else 0.0 end) as delivery_failure_rate from results group by 1),
pc as (select start, sum(d) as d from (select sent_at::timestamp as start, 1 as d from results union all select converted_at::timestamp, -1 from results where converted_at is not null) group by 1),
pg as (select unnest(generate_series(min(start), max(start), interval 1 day)) as start from pc), pw as (select start, sum(coalesce(d, 0)) over (order by start) as pending from pg left join pc using (start)),
up as (select time_bucket(interval 1 hour, created_at) as start, max(created_at) as u from tx where status = 'failed' group by 1), ug as (select unnest(generate_series(min(start), max(start), interval 1 hour)) as start from up),
uw as (select start, (epoch(start) - epoch(max(u) over (order by start))) / 3600 + 1 as hours_since_update from ug left join up using (start)),
me as (select 'latency_p99' as metric, start, latency_p99::double as value from rw where latency_p99 is not null union all select 'availability', start, availability::double from rw where availability is not null union all select 'throughput', start, throughput::double from rw union all select 'failed_logins', start, failed_logins::double from rw
union all select 'engagement_rate', start, engagement_rate::double from sd union all select 'delivery_failure_rate', start, delivery_failure_rate::double from sd union all select 'pending', start, pending::double from pw union all select 'hours_since_update', start, hours_since_update::double from uw)"""
_SERVICE_FIRED = " union all ".join(f"select '{r}' as rule, start, value, null::double as baseline, '{s}' as severity from me where metric = '{m}' and value {'>' if k == 'over' else '<'} {x}" for r, m, k, x, _, s in _SERVICE)


def _services(spark, sf):
    sends = v.campaign_results(spark, sf)
    parts = [ops.request_metrics(v.interactions(spark, sf), "timestamp", "delay_hours / 20", _CODE, "channel = 'phone'"),
             ops.send_metrics(sends, "sent_at", "opened_at is not null", "opened_at is null and conversion_value < 30000", 24),
             ops.pending_metrics(sends, "sent_at", "converted_at", 24),
             ops.staleness_metrics(v.transactions(spark, sf).where("status = 'failed'"), "created_at")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_SERVICES + " select * from me", (v.INTER, v.RESULTS, v.TX), "value")
def service_metrics(spark, sf):
    return _services(spark, sf).select("metric", F.col("at").cast("timestamp_ntz").alias("start"), "value")


@query(_SERVICES + " " + _SERVICE_FIRED, (v.INTER, v.RESULTS, v.TX), "value")
def service_alerts(spark, sf):
    return ops.business_alerts(_services(spark, sf), _SERVICE, "at").withColumn("at", F.col("at").cast("timestamp_ntz")).withColumnRenamed("at", "start")
