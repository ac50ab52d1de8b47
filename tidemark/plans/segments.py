"""Queries over users, campaigns and their results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import segments as ops
from . import views as v
from .registry import query

_AT = "timestamp '2001-08-02 00:00:00'"
_FEATURES = f""", f0 as (select id, total_deposits, total_bets, win_rate, case when floor((epoch({_AT}) - epoch(registration_date)) / 86400) > 0 then bet_count / floor((epoch({_AT}) - epoch(registration_date)) / 86400) else 0 end as bet_frequency, total_bets / bet_count as avg_bet_size,
cast(floor((epoch({_AT}) - epoch(last_activity)) / 86400) as bigint) as days_since_last_activity, cast(floor((epoch({_AT}) - epoch(registration_date)) / 86400) as bigint) as registration_days, total_deposits - total_withdrawals as ltv from users),
f as (select *, least(100, greatest(0, 100 - days_since_last_activity * 3.33::double)) as activity_score, least(1, greatest(0, least(1, days_since_last_activity / 30) * 0.4::double + least(1, greatest(0, 1 - bet_frequency / 10)) * 0.3::double + least(1, greatest(0, 1 - ltv / 1000)) * 0.2::double + least(1, greatest(0, 1 - win_rate / 100)) * 0.1::double)) as churn_risk from f0)"""
_SEGMENTED = _FEATURES + """, g as (select *, case when days_since_last_activity >= 30 or activity_score <= 20 then 'inactive' when registration_days <= 30 and total_deposits <= 100 then 'new_user' when total_deposits >= 1000 and ltv >= 2500 and bet_frequency >= 5 and churn_risk <= 0.3 then 'high_value'
when total_deposits >= 200 and ltv >= 500 and bet_frequency >= 2 and churn_risk <= 0.6 then 'medium_value' else 'low_value' end as segment from f)"""


def _features(spark, sf):
    return ops.segment_features(v.users(spark, sf), v.ORDERS_AS_OF)


@query(_FEATURES + " select * from f", (v.USERS,), "total_deposits total_bets win_rate bet_frequency avg_bet_size ltv activity_score churn_risk")
def segment_features(spark, sf):
    return _features(spark, sf)


@query(_SEGMENTED + " select id, segment, case segment when 'inactive' then 0.9 when 'new_user' then 0.85 when 'high_value' then 0.95 when 'medium_value' then 0.8 else 0.7 end::double as confidence from g", (v.USERS,), "confidence")
def rule_segment(spark, sf):
    return ops.rule_segment(_features(spark, sf)).select("id", "segment", "confidence")


@query(_SEGMENTED + """, a(segment, action, priority) as (values ('high_value', 'vip_program', 'high'), ('high_value', 'exclusive_bonus', 'high'), ('medium_value', 'deposit_bonus', 'medium'), ('medium_value', 'loyalty_points', 'medium'), ('low_value', 'free_spins', 'low'), ('new_user', 'welcome_bonus', 'high'), ('new_user', 'tutorial', 'medium'), ('inactive', 'reactivation_offer', 'high'))
select id, action, priority from g join a on a.segment = g.segment union all select id, 'retention_contact', 'urgent' from g where churn_risk > 0.7""", (v.USERS,))
def segment_recommendations(spark, sf):
    return ops.segment_recommendations(ops.rule_segment(_features(spark, sf)))


@query(_FEATURES + " select id, (least(1, registration_days / 365) + least(1, bet_frequency / 10) + activity_score / 100) / 3 * 100 as loyalty_score, (1 - churn_risk) * least(1, bet_frequency / 5) as next_deposit_probability, ltv * 1.2::double as predicted_ltv from f", (v.USERS,), "loyalty_score next_deposit_probability predicted_ltv")
def behavior_predictions(spark, sf):
    return ops.behavior_predictions(_features(spark, sf))


@query(f""", d as (select id, bet_count, floor((epoch({_AT}) - epoch(last_activity)) / 86400) n from users)
select id, case when n < 7 then 100 when n < 30 then 70 when n < 90 then 40 else 10 end as activity_bucket, case when n < 7 then 80 when n < 30 then 60 else 30 end as activity_level, case when bet_count > 12 then 'high' when bet_count > 6 then 'medium' else 'low' end as engagement_level from d""", (v.USERS,))
def behavior_levels(spark, sf):
    return ops.behavior_levels(v.users(spark, sf), v.ORDERS_AS_OF)


_SUMMARY = f"count(*) as user_count, avg(total_deposits) as avg_deposits, avg(total_bets) as avg_bets, avg(win_rate) as avg_win_rate, count(*) filter (where last_activity > {_AT} - interval 7 days) as active_7d, count(*) filter (where last_activity > {_AT} - interval 30 days) as active_30d"


@query(f"select segment, {_SUMMARY} from users where segment is not null group by segment", (v.USERS,), "avg_deposits avg_bets avg_win_rate")
def segment_summary(spark, sf):
    return ops.segment_summary(v.users(spark, sf), v.ORDERS_AS_OF)


@query(f""", s as (select cluster_id, {_SUMMARY} from users group by cluster_id)
select n.n_nationkey::bigint as cluster_id, n.n_name as cluster_name, coalesce(user_count, 0) as user_count, avg_deposits, avg_bets, avg_win_rate, coalesce(active_7d, 0) as active_7d, coalesce(active_30d, 0) as active_30d from nation n left join s on s.cluster_id = n.n_nationkey""", (v.USERS,), "avg_deposits avg_bets avg_win_rate")
def cluster_performance(spark, sf):
    return ops.cluster_performance(_clusters(spark, sf), v.users(spark, sf), v.ORDERS_AS_OF)


def _clusters(spark, sf):
    return v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("cluster_id"), F.col("n_name").alias("cluster_name"))


@query(_SEGMENTED + " select count(*) as total_users, " + ", ".join(f"count(*) filter (where segment = '{s}') as {s}_count, avg(case when segment = '{s}' then 100.0 else 0.0 end) as {s}_percentage, coalesce(avg(ltv) filter (where segment = '{s}'), 0) as {s}_avg_ltv" for s in ops.SEGMENTS) + " from g", (v.USERS,), " ".join(f"{s}_percentage {s}_avg_ltv" for s in ops.SEGMENTS))
def segment_statistics(spark, sf):
    return ops.segment_statistics(ops.rule_segment(_features(spark, sf)))


@query(""", l as (select cluster_id, 'avg_bets' as metric, avg(total_bets) as value from users where cluster_id in (1, 2, 3) group by 1 union all select cluster_id, 'user_count', count(*)::double from users where cluster_id in (1, 2, 3) group by 1)
select *, rank() over (partition by metric order by value desc) as rank from l""", (v.USERS,), "value")
def compare_clusters(spark, sf):
    return ops.compare_clusters(ops.cluster_performance(_clusters(spark, sf), v.users(spark, sf), v.ORDERS_AS_OF), [1, 2, 3], ["avg_bets", "user_count"])


def _history(spark, sf):
    """Clusters of users as a history: the present nation, and for every third user an older one."""
    users = v.users(spark, sf)
    now = users.select(F.col("id").alias("user_id"), "cluster_id", F.col("last_activity").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))
    old = users.where("id % 3 = 0").select(F.col("id").alias("user_id"), (F.col("cluster_id") + 1).alias("cluster_id"), F.col("registration_date").alias("valid_from"), F.col("last_activity").alias("valid_to"), F.lit(False).alias("is_current"))
    return now.unionByName(old)


_HISTORY = """, h as (select id as user_id, cluster_id, last_activity as valid_from, cast(null as timestamp) as valid_to, true as is_current from users union all select id, cluster_id + 1, registration_date, last_activity, false from users where id % 3 = 0)"""


@query(_FEATURES + ", c as (select id, 'segment ' || (cluster_id % 5) as cluster_name from users where id % 2 = 0) select users.id, users.name, c.cluster_name, case when c.id is not null then f.churn_risk end as churn_risk from users join f on f.id = users.id left join c on c.id = users.id", (v.USERS,), "churn_risk")
def active_users_with_clusters(spark, sf):
    return ops.active_users_with_clusters(v.users(spark, sf), _current(spark, sf))


def _current(spark, sf):
    users = v.users(spark, sf)
    return users.where("id % 2 = 0").join(_features(spark, sf).select("id", "churn_risk"), "id").select(F.col("id").alias("user_id"), F.concat(F.lit("segment "), F.col("cluster_id") % 5).alias("cluster_name"), "churn_risk", F.lit(True).alias("is_current"))


@query(_FEATURES + f" select users.id, f.churn_risk, f.days_since_last_activity as days_inactive from users join f on f.id = users.id where users.id % 2 = 0 and (f.churn_risk > 0.7 or last_activity < {_AT} - interval 14 days) and users.total_deposits > 100", (v.USERS,), "churn_risk")
def high_risk_users(spark, sf):
    return ops.high_risk_users(v.users(spark, sf), _current(spark, sf), v.ORDERS_AS_OF)


@query(""", r as (select 'users' as metric, count(*) as value from users union all select 'transactions', count(*) from tx union all select 'transactions_without_user', count(*) filter (where user_id is null) from tx union all select 'failed_transactions', count(*) filter (where status = 'failed') from tx)
select metric, value, case when metric in ('transactions_without_user', 'failed_transactions') then case when value = 0 then 'ok' else 'warning' end when value > 0 then 'ok' else 'critical' end as status from r""", (v.USERS, v.TX))
def data_health(spark, sf):
    return ops.data_health(v.users(spark, sf), v.transactions(spark, sf))


@query(""", r as (select campaign_id, count(*) s, count(opened_at) o, count(clicked_at) k, count(converted_at) c, sum(conversion_value) filter (where converted_at is not null) v from results group by 1)
select campaigns.*, coalesce(s, 0) as total_sent, coalesce(o, 0) as total_opened, coalesce(k, 0) as total_clicked, coalesce(c, 0) as total_converted, coalesce(v, 0) as total_revenue, round(coalesce(o * 100 / s, 0), 2) as open_rate, round(coalesce(k * 100 / nullif(o, 0), 0), 2) as click_rate, round(coalesce(c * 100 / nullif(k, 0), 0), 2) as conversion_rate from campaigns left join r on r.campaign_id = campaigns.campaign_id""", (v.CAMPAIGNS, v.RESULTS), "total_revenue open_rate click_rate conversion_rate")
def campaign_performance(spark, sf):
    return ops.campaign_performance(v.campaigns(spark, sf), v.campaign_results(spark, sf))


@query(""", s as (select user_id, sent_at, max(campaign_id) as campaign_id from results where opened_at is not null group by 1, 2), t as (select o_orderkey as tx_id, o_custkey as user_id, o_orderdate as t0, o_totalprice as value from orders), j as (select t.*, s.sent_at, s.campaign_id from t asof left join s on s.user_id = t.user_id and t.t0 >= s.sent_at)
select tx_id, user_id, value, case when sent_at >= t0 - interval 7 days then campaign_id end as campaign_id from j""", (v.RESULTS,), "value")
def attribute_conversions(spark, sf):
    sends = v.campaign_results(spark, sf).where("opened_at is not null").groupBy("user_id", "sent_at").agg(F.max("campaign_id").alias("campaign_id"))
    tx = v.table(spark, sf, "orders").selectExpr("o_orderkey as tx_id", "o_custkey as user_id", "cast(o_orderdate as timestamp) as `at`", "o_totalprice as value")
    return ops.attribute_conversions(sends, tx)


@query(_HISTORY + """, n as (select id as user_id, cluster_id + id % 2 as cluster_id from users where id % 5 <> 0), j as (select h.*, n.cluster_id as new, n.user_id is not null and is_current and n.cluster_id <> h.cluster_id as ends from h left join n on n.user_id = h.user_id)
select user_id, cluster_id, valid_from, case when ends then timestamp '2001-08-02' else valid_to end as valid_to, is_current and not ends as is_current from j union all select user_id, new, timestamp '2001-08-02', null, true from j where ends""", (v.USERS,))
def scd2_apply(spark, sf):
    new = v.users(spark, sf).where("id % 5 <> 0").select(F.col("id").alias("user_id"), (F.col("cluster_id") + F.col("id") % 2).alias("cluster_id"))
    out = ops.scd2_apply(_history(spark, sf), new, v.ORDERS_AS_OF)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


@query(_HISTORY + " select user_id, cluster_id, is_current from h where valid_from <= timestamp '2000-01-01' and (valid_to is null or timestamp '2000-01-01' < valid_to)", (v.USERS,))
def scd2_as_of(spark, sf):
    return ops.scd2_as_of(_history(spark, sf), dt.datetime(2000, 1, 1)).select("user_id", "cluster_id", "is_current")


@query("select id, name, segment from users where name ilike '%1%' and segment = 'BUILDING' order by last_activity desc, id limit 20", (v.USERS,))
def search_users(spark, sf):
    return ops.search_users(v.users(spark, sf), name="1", segment="BUILDING").select("id", "name", "segment")


@query("select c_custkey, c_name, c_mktsegment from customer where lower(concat_ws(' ', c_name, c_mktsegment)) like '%mach%' and c_name like '%2%' order by c_name desc")
def table_view(spark, sf):
    return ops.table_view(v.table(spark, sf, "customer"), "Mach", ["c_name", "c_mktsegment"], {"c_name": "2"}, "c_name", True).select("c_custkey", "c_name", "c_mktsegment")


@query(f"select id, name, total_deposits - total_withdrawals as ltv, case when floor((epoch({_AT}) - epoch(last_activity)) / 86400) < 7 then 100 when floor((epoch({_AT}) - epoch(last_activity)) / 86400) < 30 then 70 when floor((epoch({_AT}) - epoch(last_activity)) / 86400) < 90 then 40 else 10 end as activity_score from users where cluster_id = 3 order by ltv desc, id limit 10", (v.USERS,), "ltv")
def users_by_cluster(spark, sf):
    return ops.users_by_cluster(v.users(spark, sf), 3, 1, 10, v.ORDERS_AS_OF)


@query("select o_custkey as user_id, sum(o_totalprice) as revenue from orders group by 1 order by 2 desc, 1 limit 10", (), "revenue")
def top_k(spark, sf):
    return ops.top_k(v.table(spark, sf, "orders").selectExpr("o_custkey as user_id", "o_totalprice as revenue"), "user_id", "revenue", 10)


@query(" select user_id, game_id, rating, rank from (select *, row_number() over (partition by user_id order by rating desc, game_id) as rank from ratings) where rank <= 3", (v.RATINGS,), "rating")
def top_k_per(spark, sf):
    return ops.top_k_per(v.ratings(spark, sf), "user_id", [F.desc("rating"), F.col("game_id")], 3).select("user_id", "game_id", "rating", "rank")


@query("select id from (select c_custkey as id, row_number() over (order by c_custkey) - 1 as k from customer join (select distinct o_custkey from orders) on o_custkey = c_custkey) where k % 10 = 0")
def systematic_sample(spark, sf):
    return ops.systematic_sample(v.users(spark, sf), "id", 10).select("id")


@query("select c_custkey as id, cast('0x' || substr(md5(c_custkey::varchar), 1, 8) as bigint) % 1000 < 200 as is_validation from customer")
def split(spark, sf):
    return ops.split(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")


@query(" select 'total' as facet, 'all' as value, count(*) as n from users where name ilike '%1%' union all select 'segment', segment, count(*) from users where name ilike '%1%' group by segment union all select 'cluster', cluster_id::varchar, count(*) from users where name ilike '%1%' group by cluster_id", (v.USERS,))
def search_facets(spark, sf):
    return ops.search_facets(v.users(spark, sf), name="1")


@query("select c_custkey as id, cast(('0x' || md5(c_custkey::varchar))::uhugeint % 100 as int) as bucket, case when ('0x' || md5(c_custkey::varchar))::uhugeint % 100 < 50 then 'b' else 'a' end as variant from customer")
def ab_assign(spark, sf):
    users = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("key"))
    return ops.ab_assign(users, "key").select("id", "bucket", "variant")


@query(""", r as (select case when user_id % 2 = 0 then 'b' else 'a' end as variant, converted_at is not null as c from results where opened_at is not null), s as (select count(*) filter (where variant = 'a') n_a, count(*) filter (where variant = 'b') n_b, count(*) filter (where variant = 'a' and c) c_a, count(*) filter (where variant = 'b' and c) c_b from r), q as (select n_a, n_b, c_a / n_a as ra, c_b / n_b as rb, (c_a + c_b) / (n_a + n_b) as p from s)
select n_a, n_b, ra as rate_a, rb as rate_b, (rb - ra) / ra as relative_lift, (rb - ra) / sqrt(p * (1 - p) * (1.0 / n_a + 1.0 / n_b)) as z, case when n_a < 100 or n_b < 100 then 'insufficient' when rb > ra then 'b' when ra > rb then 'a' else 'tie' end as winner from q""", (v.RESULTS,), "rate_a rate_b relative_lift z")
def ab_results(spark, sf):
    rows = v.campaign_results(spark, sf).where("opened_at is not null").select(F.when(F.col("user_id") % 2 == 0, "b").otherwise("a").alias("variant"), F.col("converted_at").isNotNull().alias("converted"))
    return ops.ab_results(rows)


@query(""", w as (select event_id as send_id, user_id, count(*) over (partition by user_id order by epoch(timestamp)::bigint range between 86400 preceding and current row) d, count(*) over (partition by user_id order by epoch(timestamp)::bigint range between 604800 preceding and current row) k from (select *, date_trunc('second', timestamp) t from inter))
select send_id, user_id, d as day_count, k as week_count, d <= 3 and k <= 10 as allowed from w""", (v.INTER,))
def frequency_cap(spark, sf):
    sends = v.interactions(spark, sf).select(F.col("event_id").alias("send_id"), "user_id", F.col("timestamp").alias("sent_at"))
    return ops.frequency_cap(sends, 3, 10).select("send_id", "user_id", "day_count", "week_count", "allowed")


@query(_SEGMENTED + ", s as (select segment, (1 - churn_risk) * win_rate / 100 as p, ltv as v from g) select segment, count(*) as targeted, sum(p) as expected_conversions, sum(p * v) as expected_revenue, count(*) * 2.0::double as cost, (sum(p * v) - count(*) * 2.0) / (count(*) * 2.0) as roi from s group by segment", (v.USERS,), "expected_conversions expected_revenue cost roi")
def campaign_forecast(spark, sf):
    rows = ops.rule_segment(_features(spark, sf)).select("segment", ((1 - F.col("churn_risk")) * F.col("win_rate") / 100).alias("conversion_probability"), F.col("ltv").alias("value"))
    return ops.campaign_forecast(rows, 2.0)


@query("select id, name from users where last_activity > timestamp '2001-07-01'", (v.USERS,))
def changed_since(spark, sf):
    return ops.changed_since(v.users(spark, sf), "last_activity", dt.datetime(2001, 7, 1)).select("id", "name")


@query(" select id, name, segment from users where id = 7", (v.USERS,))
def get_user(spark, sf):
    return v.users(spark, sf).where("id = 7").select("id", "name", "segment")
