"""Queries of derived features, aggregated-row variants and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import quotient
from ..operators import derived as ops
from ..operators import profiles
from . import views as v
from .registry import query

_O = "over (partition by user_id order by timestamp, event_id)"


@query(" select user_id, avg(session_duration) as session_mean, median(session_duration) as session_median, stddev_samp(session_duration) as session_std, max(session_duration) as session_max, count(session_duration) as session_count from bets group by user_id", (v.BETS,), "session_mean session_median session_std session_max")
def session_stats(spark, sf):
    return ops.session_stats(v.bets(spark, sf))


@query(", a as (select user_id, sum(bet_amount) as total from bets group by 1) select event_id, bets.user_id, total, bet_amount / total as share_of_total from bets left join a on a.user_id = bets.user_id", (v.BETS,), "total share_of_total")
def attach(spark, sf):
    b = v.bets(spark, sf)
    return ops.attach(b, b.groupBy("user_id").agg(F.sum("bet_amount").alias("total")), "user_id").select("event_id", "user_id", "total", (F.col("bet_amount") / F.col("total")).alias("share_of_total"))


@query(""", a as (select user_id, sum(bet_amount) as wagered, count(*) as n from bets group by 1), b as (select user_id, avg(engagement_score) as engagement from inter where responded = 1 group by 1)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(wagered, 0) as bets_wagered, coalesce(n, 0) as bets_n, coalesce(engagement, 0) as talks_engagement from a full join b on a.user_id = b.user_id""", (v.BETS, v.INTER), "bets_wagered talks_engagement")
def assemble_features(spark, sf):
    bets = v.bets(spark, sf).groupBy("user_id").agg(F.sum("bet_amount").alias("wagered"), F.count("*").alias("n"))
    talks = v.interactions(spark, sf).where("responded = 1").groupBy("user_id").agg(F.avg("engagement_score").alias("engagement"))
    return ops.assemble_features({"bets": bets, "talks": talks})


@query(f""", r as (select user_id, epoch(timestamp) as t, row_number() {_O} as k, count(*) over (partition by user_id) as n from bets), h as (select user_id, k <= n // 2 as early, count(*) as c, max(t) - min(t) as span from r group by 1, 2),
p as (select user_id, max(c / nullif(span, 0)) filter (where early) as a, max(c / nullif(span, 0)) filter (where not early) as b from h group by 1) select user_id, (b - a) / a as frequency_trend from p""", (v.BETS,), "frequency_trend")
def frequency_trend(spark, sf):
    return ops.frequency_trend(v.bets(spark, sf))


@query(f""", r as (select user_id, bet_amount as y, row_number() {_O} - 1 as x from bets) select user_id, case when count(*) >= 3 then regr_slope(y, x) else 0 end / (avg(y) + 1e-8) as bet_escalation from r group by user_id""", (v.BETS,), "bet_escalation")
def bet_escalation(spark, sf):
    return ops.bet_escalation(v.bets(spark, sf)).drop("escalation_significance")


# 1 - p of a correlation by the finite series of Student's t for whole degrees of freedom f: s is |r| and c is 1 - r².
_SERIES = """case when isnan(r2) then r2 when flat then 0 when f % 2 = 0 then s * list_sum(list_transform(range(0, f // 2), lambda j: exp(lgamma(j + 0.5::double) - lgamma(j + 1::double)) / sqrt(pi()) * power(c, j)))
else 2 / pi() * (atan2(s, sqrt(c)) + s * sqrt(c) * coalesce(list_sum(list_transform(range(0, (f - 1) // 2), lambda j: exp(lgamma(j + 1::double) - lgamma(j + 1.5::double)) * sqrt(pi()) / 2 * power(c, j))), 0)) end"""


@query(f""", r as (select user_id, win_amount / bet_amount as y, row_number() {_O} - 1 as x from bets),
t as (select user_id, regr_slope(y, x) as performance_improvement, regr_r2(y, x) as r2, regr_syy(y, x) = 0 as flat, regr_count(y, x)::bigint - 2 as f from r group by user_id having count(*) >= 3), u as (select *, sqrt(r2) as s, greatest(0, 1 - r2) as c from t)
select user_id, performance_improvement, r2 as improvement_consistency, {_SERIES} as improvement_significance from u""", (v.BETS,), "performance_improvement improvement_consistency improvement_significance")
def learning_trend(spark, sf):
    return ops.learning_trend(v.bets(spark, sf), quotient(F.col("win_amount"), F.col("bet_amount")))


@query()
def trend_significance(spark, sf):
    """1 - p of both trends."""
    b = v.bets(spark, sf)
    return ops.bet_escalation(b).join(ops.learning_trend(b, quotient(F.col("win_amount"), F.col("bet_amount"))), "user_id", "left").select("user_id", "escalation_significance", "improvement_significance")


@query(""", w as (select user_id, coalesce(avg(bet_amount) filter (where timestamp > timestamp '2024-01-31' - interval 7 days), 0) as avg_bet_7d, (count(*) filter (where timestamp > timestamp '2024-01-31' - interval 7 days))::double as session_frequency, avg(case when win_amount > 0 then 1.0 else 0.0 end) as win_rate, (epoch(timestamp '2024-01-31') - max(epoch(timestamp))) / 86400 as days from bets where timestamp <= timestamp '2024-01-31' group by 1),
c as (select *, least(1, days / 30) * (1 - least(1, avg_bet_7d / 100)) as churn_risk from w) select user_id, avg_bet_7d, session_frequency, win_rate, churn_risk, avg_bet_7d * session_frequency * 52 * (1 - churn_risk) as ltv_prediction from c""", (v.BETS,), "avg_bet_7d session_frequency win_rate churn_risk ltv_prediction")
def store_features(spark, sf):
    return ops.store_features(v.bets(spark, sf), F.lit(v.EVENTS_AS_OF))


#: One row per user, as upstream jobs deliver them.
_AGG = """, ag as (select user_id, avg(bet_amount) * 15 as avg_bet_amount, max(bet_amount) * 15 as max_bet_amount, stddev_samp(bet_amount) * 15 as bet_std, count(*) as total_bets, sum(bet_amount) as total_amount, coalesce(sum(deposit_amount), 0) as total_deposits, sum(win_amount) as total_won, sum(bet_amount) as total_wagered, avg(case when win_amount > 0 then 1.0 else 0.0 end) as win_rate, count(*)::double / 4 as session_frequency,
count(distinct cast(timestamp as date)) as days_active, count(*) as total_sessions, avg(session_duration) / 60 as avg_session_duration, avg(games_played) as avg_games_per_session, (epoch(timestamp '2024-01-31') - max(epoch(timestamp))) / 86400 as days_since_last_bet, hour(max(timestamp)) as preferred_hour, avg(promotion_used) as cashback_usage, 18 + user_id % 60 as age,
avg(case when game_type = 'esportes' then 1.0 else 0.0 end) as sports_bet_ratio, avg(case when game_type = 'slots' then 1.0 else 0.0 end) as game_slots_ratio, avg(case when game_type = 'poker' then 1.0 else 0.0 end) as game_poker_ratio from bets group by user_id)"""


def _aggregated(spark, sf):
    of = lambda c: F.avg(c.cast("double"))
    return v.bets(spark, sf).groupBy("user_id").agg(
        (F.avg("bet_amount") * 15).alias("avg_bet_amount"), (F.max("bet_amount") * 15).alias("max_bet_amount"), (F.stddev_samp("bet_amount") * 15).alias("bet_std"), F.count("*").alias("total_bets"), F.sum("bet_amount").alias("total_amount"),
        F.coalesce(F.sum("deposit_amount"), F.lit(0.0)).alias("total_deposits"), F.sum("win_amount").alias("total_won"), F.sum("bet_amount").alias("total_wagered"), of(F.col("win_amount") > 0).alias("win_rate"), (F.count("*") / 4).alias("session_frequency"),
        F.countDistinct(F.to_date("timestamp")).alias("days_active"), F.count("*").alias("total_sessions"), (F.avg("session_duration") / 60).alias("avg_session_duration"), F.avg("games_played").alias("avg_games_per_session"),
        ((F.lit(v.EVENTS_AS_OF).cast("double") - F.max("timestamp").cast("double")) / 86400).alias("days_since_last_bet"), F.hour(F.max("timestamp")).alias("preferred_hour"), F.avg("promotion_used").alias("cashback_usage"), (18 + F.max("user_id") % 60).alias("age"),
        of(F.col("game_type") == "esportes").alias("sports_bet_ratio"), of(F.col("game_type") == "slots").alias("game_slots_ratio"), of(F.col("game_type") == "poker").alias("game_poker_ratio"))


@query(_AGG + """ select user_id, avg_bet_amount as avg_bet, cast(null as double) as total_wagered, max_bet_amount as max_bet, max_bet_amount / (avg_bet_amount + 1e-8) as max_bet_ratio, case when avg_bet_amount >= 10000 then 3 when avg_bet_amount >= 1000 then 2 else 1 end as user_tier, total_deposits,
case when total_deposits > 0 then avg_bet_amount / total_deposits end as bet_sizing_ratio, bet_std / avg_bet_amount as normalized_volatility, win_rate, (total_won - total_wagered) / total_wagered as roi, total_won / total_wagered as rtp, least(max_bet_amount / (avg_bet_amount + 1e-8) / 10, 1) as risk_concentration from ag""", (v.BETS,), "avg_bet total_wagered max_bet max_bet_ratio total_deposits bet_sizing_ratio normalized_volatility win_rate roi rtp risk_concentration")
def financial_from_aggregates(spark, sf):
    return ops.financial_from_aggregates(_aggregated(spark, sf))


@query(_AGG + """, g as (select *, game_slots_ratio + game_poker_ratio as t from ag) select user_id, max_bet_amount / (avg_bet_amount + 1e-8) as bet_max_ratio, total_amount / total_bets as avg_bet_normalized, abs(win_rate - 0.5) * 2 as win_rate_extremity, least(session_frequency / 30, 2) as session_frequency_normalized, least(total_sessions / greatest(days_active, 1), 5) / 5 as daily_activity_consistency,
avg_games_per_session / (avg_session_duration / 60) as session_intensity, 1 / (1 + days_since_last_bet / 7) as recency_score, least(session_frequency / 30, 1) as frequency_score,
case when t > 0 then case when game_slots_ratio > 0 then -game_slots_ratio / t * ln(game_slots_ratio / t) else 0 end + case when game_poker_ratio > 0 then -game_poker_ratio / t * ln(game_poker_ratio / t) else 0 end end as ratio_entropy,
abs(sports_bet_ratio - 0.5) * 2 as specialization_score, abs(win_rate - 0.5) as skill_indicator, least(ln(1 + total_bets) / 10, 1) as experience_level, case when preferred_hour between 18 and 23 then 1.0 when preferred_hour between 0 and 6 then 0.0 else 0.5 end as social_timing, cashback_usage as promotion_engagement from g""", (v.BETS,),
       "bet_max_ratio avg_bet_normalized win_rate_extremity session_frequency_normalized daily_activity_consistency session_intensity recency_score frequency_score ratio_entropy specialization_score skill_indicator experience_level social_timing promotion_engagement")
def behavior_from_aggregates(spark, sf):
    return ops.behavior_from_aggregates(_aggregated(spark, sf), game_ratios=("game_slots_ratio", "game_poker_ratio"))


@query(_AGG + """ select user_id, preferred_hour::double as preferred_hour, cast(preferred_hour <= 6 as int) as night_activity_ratio, cast(preferred_hour >= 18 as int) as peak_hours_ratio, cast(preferred_hour between 7 and 17 as int) as business_hours_ratio, case when preferred_hour >= 22 or preferred_hour <= 2 then 0.7 else 0.3 end::double as weekend_activity_ratio, least(session_frequency / 21, 1) as weekly_diversity,
168 / greatest(session_frequency, 1) as avg_session_interval, least(session_frequency / 14, 1) as cycle_regularity, 1 / (1 + days_since_last_bet / 7) as cycle_activity, cast(preferred_hour <= 8 as int) as early_starter, cast(preferred_hour >= 22 as int) as late_finisher, 1 / (1 + days_since_last_bet / 30) as activity_recency, 0.5::double as monthly_seasonality, 0.25::double as quarter_concentration from ag""", (v.BETS,),
       "preferred_hour weekend_activity_ratio weekly_diversity avg_session_interval cycle_regularity cycle_activity activity_recency monthly_seasonality quarter_concentration")
def temporal_from_aggregates(spark, sf):
    return ops.temporal_from_aggregates(_aggregated(spark, sf))


@query(_AGG + """ select user_id, case when age < 25 then 0.2 when age < 40 then 0.4 else 0.5 end::double as email_usage_ratio, case when age < 25 then 0.1 when age < 40 then 0.2 else 0.3 end::double as sms_usage_ratio, case when age < 25 then 0.4 when age < 40 then 0.3 else 0.1 end::double as push_usage_ratio,
case when age < 25 then 0.3 else 0.1 end::double as in_app_usage_ratio, case when age < 40 then 0.1 else 0.2 end::double as phone_usage_ratio, cashback_usage as promotion_content_ratio from ag""", (v.BETS,), "email_usage_ratio sms_usage_ratio push_usage_ratio in_app_usage_ratio phone_usage_ratio promotion_content_ratio")
def communication_from_aggregates(spark, sf):
    return ops.communication_from_aggregates(_aggregated(spark, sf))


@query(_AGG + """, w as (select preferred_hour as h, case when preferred_hour >= 22 or preferred_hour <= 2 then 0.7 else 0.3 end::double as w from ag) select (select h from w group by h order by count(*) desc, h limit 1)::double as most_common_hour, avg(h) as mean_hour, avg(case when w > 0.6 then 1.0 else 0.0 end) as weekend_heavy, avg(case when w < 0.2 then 1.0 else 0.0 end) as weekday_only, avg(case when w between 0.4 and 0.6 then 1.0 else 0.0 end) as balanced from w""", (v.BETS,), "most_common_hour mean_hour weekend_heavy weekday_only balanced")
def temporal_insights(spark, sf):
    return ops.temporal_insights(ops.temporal_from_aggregates(_aggregated(spark, sf)), "preferred_hour", "weekend_activity_ratio")


@query(_AGG + """, f as (select case when avg_bet_amount >= 10000 then 3 when avg_bet_amount >= 1000 then 2 else 1 end as user_tier, (total_won - total_wagered) / total_wagered as roi, bet_std / avg_bet_amount as v from ag)
select avg(case when user_tier = 3 then 1.0 else 0.0 end) as whale_share, avg(case when user_tier = 2 then 1.0 else 0.0 end) as high_roller_share, avg(case when user_tier = 1 then 1.0 else 0.0 end) as regular_share, avg(case when roi > 0 then 1.0 else 0.0 end) as profitable_share, avg(roi) as mean_roi, avg(case when roi > 0.1 then 1.0 else 0.0 end) as high_profit_share,
avg(case when v < 0.5 then 1.0 when v >= 0.5 then 0.0 end) as low_volatility_share, avg(case when v > 2 then 1.0 when v <= 2 then 0.0 end) as high_volatility_share, avg(v) as mean_volatility, (select quantile_disc(roi, 0.5) from f) as median_roi from f""", (v.BETS,), "whale_share high_roller_share regular_share profitable_share mean_roi high_profit_share low_volatility_share high_volatility_share mean_volatility median_roi")
def financial_insights(spark, sf):
    return profiles.financial_insights(ops.financial_from_aggregates(_aggregated(spark, sf)))


@query(""", u as (select user_id, avg(responded) as r, hour(max(timestamp)) as h from inter group by 1) select (select h from u group by h order by count(*) desc, h limit 1)::int as peak_hour, avg(r) as avg_response_rate, avg(case when r > 0.3 then 1.0 else 0.0 end) as highly_responsive, avg(case when r < 0.1 then 1.0 else 0.0 end) as low_responsive, avg(h) as avg_hour from u""", (v.INTER,), "avg_response_rate highly_responsive low_responsive avg_hour")
def communication_insights(spark, sf):
    return ops.communication_insights(v.interactions(spark, sf).groupBy("user_id").agg(F.avg("responded").alias("r"), F.hour(F.max("timestamp")).alias("h")), "r", "h")


@query(" select campaign_type as kind, count(*) as total, count(*) filter (where responded = 1) as active, count(*) filter (where responded <> 1) as withdrawn, avg(responded) as consent_rate from inter group by 1", (v.INTER,), "consent_rate")
def consent_metrics(spark, sf):
    return ops.consent_metrics(v.interactions(spark, sf), "campaign_type", F.col("responded") == 1)
