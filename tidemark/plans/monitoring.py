"""Queries of rates, health, sampling and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as ops
from . import views as v
from .registry import query


@query(" select channel, time_bucket(interval 1 day, created_at) as start, count(*) as n, avg(case when status = 'failed' then 1.0 else 0.0 end) as rate from tx group by 1, 2", (v.TX,), "rate")
def rate_by(spark, sf):
    return ops.rate_by(v.transactions(spark, sf), "channel", "created_at", "status = 'failed'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(", g as (select *, case when event_id % 7 <> 0 then game_type end as kind from bets) select event_id, coalesce(deposit_amount, (select median(deposit_amount) from bets)) as deposit_amount, coalesce(kind, (select kind from g where kind is not null group by kind order by count(*) desc, kind limit 1)) as kind from g", (v.BETS,), "deposit_amount")
def impute(spark, sf):
    return ops.impute(v.bets(spark, sf).select("event_id", "deposit_amount", F.when(F.col("event_id") % 7 != 0, F.col("game_type")).alias("kind")), ["deposit_amount", "kind"])


@query(""", c as (select avg(bet_amount) x, avg(session_duration) y from bets), r as (select event_id, bet_amount, session_duration, avg(bet_amount) over w a, avg(session_duration) over w b from bets window w as (order by timestamp, event_id rows between 5 preceding and 5 following))
select event_id, round(0.3 * sqrt(power(bet_amount - x, 2) + power(session_duration - y, 2)) + 0.7 * sqrt(power(bet_amount - a, 2) + power(session_duration - b, 2)), 6) as importance from r, c order by importance desc, event_id limit 50""", (v.BETS,), "importance")
def importance_sample(spark, sf):
    return ops.importance_sample(v.bets(spark, sf), "event_id", "bet_amount", "session_duration", 50, "timestamp")


@query(""", h as (select user_id, hour(timestamp) h, round(avg(session_duration), 9) d, round(avg(bet_amount), 9) b from bets group by 1, 2), r as (select *, rank() over (partition by user_id order by h) rh, rank() over (partition by user_id order by b) + (count(*) over (partition by user_id, b) - 1) / 2 rb, row_number() over (partition by user_id order by d desc, h) k from h)
select user_id, stddev_samp(d) / (avg(d) + 1e-8) as duration_by_hour_cv, cast(max(h) filter (where k = 1) as int) as best_hour, corr(rh, rb) as hour_bet_correlation from r group by user_id""", (v.BETS,), "duration_by_hour_cv hour_bet_correlation")
def timing(spark, sf):
    return ops.timing(v.bets(spark, sf))


@query(""", m as (select channel, time_bucket(interval 6 hours, timestamp) as start, count(*) as requests, avg(case when interaction_type = 'support_ticket' then 1.0 else 0.0 end) as error_rate, avg(delay_hours / 20) as mean_latency, avg(case when interaction_type <> 'support_ticket' and responded = 0 then 1.0 else 0.0 end) as ok from inter group by 1, 2)
select * exclude (ok), case when error_rate > 0.05 then 'unhealthy' when mean_latency > 1 then 'degraded' when ok < 0.95 then 'warning' else 'healthy' end as status from m""", (v.INTER,), "error_rate mean_latency")
def model_health(spark, sf):
    rows = v.interactions(spark, sf).withColumn("latency", F.col("delay_hours") / 20)
    return ops.model_health(rows, "channel", "timestamp", "interaction_type = 'support_ticket'", "latency", 360, "interaction_type <> 'support_ticket' and responded = 0").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(""" with recursive e as (select c_custkey as feature, c_custkey // 2 as base from customer where c_custkey > 1), p as (select base, feature, 1 as depth from e union all select p.base, e.feature, depth + 1 from p join e on e.base = p.feature)
select base as feature, count(*) as dependents, cast(max(depth) as int) as depth, case when count(*) > 10 then 'high' when count(*) > 5 then 'medium' else 'low' end as impact from p group by base""")
def lineage(spark, sf):
    ids = v.table(spark, sf, "customer").where("c_custkey > 1")
    return ops.lineage(ids.select(F.col("c_custkey").alias("feature"), F.floor(F.col("c_custkey") / 2).alias("depends_on")))


@query("select p_partkey as feature, substr(sha256(p_name || p_type), 1, 8) as version from part")
def definition_versions(spark, sf):
    """Names and types of parts stand for queries and logic."""
    return ops.definition_versions(v.table(spark, sf, "part"), "p_name", "p_type").select(F.col("p_partkey").alias("feature"), "version")
