"""Queries over the transactions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transactions as ops
from . import views as v
from .registry import query

_AS_OF = "timestamp '2024-01-31 00:00:00'"


@query("select user_id, count(*) as total_transactions, sum(case when transaction_type = 'deposit' then amount else 0 end) as total_deposits, sum(case when transaction_type = 'withdrawal' then amount else 0 end) as total_withdrawals, sum(case when transaction_type = 'bet' then amount else 0 end) as total_bets, sum(case when transaction_type = 'win' then amount else 0 end) as total_wins, avg(amount) as avg_transaction_amount, count(distinct game_type) as unique_games_played, max(created_at) as last_transaction_date, date_trunc('day', max(created_at)) as last_activity_date from tx where status = 'completed' and created_at >= " + _AS_OF + " - interval 30 days group by user_id",
       (v.TX,), "total_deposits total_withdrawals total_bets total_wins avg_transaction_amount")
def user_transaction_summary(spark, sf):
    out = ops.user_transaction_summary(v.transactions(spark, sf), v.EVENTS_AS_OF)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_transaction_date", "last_activity_date")})


@query("select cast(created_at as date) as transaction_date, transaction_type, status, count(*) as transaction_count, sum(amount) as total_amount, avg(amount) as avg_amount, min(amount) as min_amount, max(amount) as max_amount from tx where created_at >= " + _AS_OF + " - interval 7 days group by 1, 2, 3",
       (v.TX,), "total_amount avg_amount min_amount max_amount")
def daily_transaction_metrics(spark, sf):
    return ops.daily_transaction_metrics(v.transactions(spark, sf), v.EVENTS_AS_OF)


@query("select cast(created_at as date) as activity_date, transaction_type as activity_type, count(*) as activity_count, count(distinct user_id) as unique_users, coalesce(sum(amount), 0) as total_value, avg(amount) as avg_value from tx where created_at >= " + _AS_OF + " - interval 90 days group by 1, 2",
       (v.TX,), "total_value avg_value")
def daily_user_activity(spark, sf):
    return ops.daily_user_activity(v.transactions(spark, sf), v.EVENTS_AS_OF)


@query(f""", r as (select user_id, cast(floor((epoch({_AS_OF}) - epoch(max(created_at))) / 86400) as bigint) as recency_days, count(created_at) as frequency_transactions, sum(amount) as monetary_value from tx group by user_id),
q as (select quantile_cont(recency_days, 0.25) r1, quantile_cont(recency_days, 0.5) r2, quantile_cont(recency_days, 0.75) r3, quantile_cont(frequency_transactions, 0.25) f1, quantile_cont(frequency_transactions, 0.5) f2, quantile_cont(frequency_transactions, 0.75) f3, quantile_cont(monetary_value, 0.25) m1, quantile_cont(monetary_value, 0.5) m2, quantile_cont(monetary_value, 0.75) m3 from r),
s as (select r.*, case when recency_days <= r1 then 4 when recency_days <= r2 then 3 when recency_days <= r3 then 2 else 1 end as recency_score, case when frequency_transactions <= f1 then 1 when frequency_transactions <= f2 then 2 when frequency_transactions <= f3 then 3 else 4 end as frequency_score, case when monetary_value <= m1 then 1 when monetary_value <= m2 then 2 when monetary_value <= m3 then 3 else 4 end as monetary_score from r, q),
t as (select *, recency_score * 100 + frequency_score * 10 + monetary_score as rfm_score from s)
select *, case when rfm_score >= 444 then 'champions' when rfm_score >= 334 then 'loyal_customers' when rfm_score >= 224 then 'potential_loyalists' when rfm_score >= 144 then 'at_risk' else 'hibernating' end as rfm_segment from t""", (v.TX,), "monetary_value")
def rfm(spark, sf):
    return ops.rfm(v.transactions(spark, sf), v.EVENTS_AS_OF)


@query(""", c as (select user_id, game_type, count(*) n from tx group by 1, 2), f as (select user_id, game_type, row_number() over (partition by user_id order by n desc, game_type) k from c)
select tx.user_id, max(f.game_type) as favorite_game_type, count(tx.game_type) as game_type_count, count(distinct tx.game_type) as game_type_distinct, count(distinct tx.game_type) / count(tx.game_type) as game_type_diversity from tx join f on f.user_id = tx.user_id and f.k = 1 group by tx.user_id""", (v.TX,), "game_type_diversity")
def category_preference(spark, sf):
    return ops.category_preference(v.transactions(spark, sf))


@query("select user_id, " + ", ".join(f"coalesce(avg(amount) filter (where game_type = '{g}'), 0) as avg_bet_{g}" for g in v.GAME_TYPES) + " from tx group by user_id", (v.TX,), " ".join(f"avg_bet_{g}" for g in v.GAME_TYPES))
def avg_bet_by_game(spark, sf):
    return ops.avg_amount_by(v.transactions(spark, sf), "game_type", v.GAME_TYPES)


@query("select user_id, " + ", ".join(f"count(*) filter (where created_at >= {_AS_OF} - interval {p} days) as frequency_last_{p}_days" for p in ops.PERIODS) + " from tx group by user_id", (v.TX,))
def period_frequency(spark, sf):
    return ops.period_frequency(v.transactions(spark, sf), v.EVENTS_AS_OF)


@query("""select user_id, avg(amount) as ticket_mean, median(amount) as ticket_median, stddev_samp(amount) as ticket_std, min(amount) as ticket_min, max(amount) as ticket_max, count(amount) as ticket_count, sum(amount) as ticket_sum,
case when avg(amount) < 50 then 'baixo' when avg(amount) < 500 then 'medio' else 'alto' end as ticket_category, case when avg(amount) > 0 then stddev_samp(amount) / avg(amount) else 0 end as bet_volatility,
case when count(*) > 1 then count(*) / (floor((epoch(max(created_at)) - epoch(min(created_at))) / 86400) + 1) else 0 end as activity_frequency from tx group by user_id""", (v.TX,), "ticket_mean ticket_median ticket_std ticket_min ticket_max ticket_sum bet_volatility activity_frequency")
def ticket_stats(spark, sf):
    return ops.ticket_stats(v.transactions(spark, sf))


@query("""select user_id, sum(case when transaction_type in ('deposit', 'bonus') then amount else 0 end) as deposit_sum, count(*) filter (where transaction_type in ('deposit', 'bonus')) as deposit_count, sum(case when transaction_type in ('withdrawal', 'win') then amount else 0 end) as withdrawal_sum, count(*) filter (where transaction_type in ('withdrawal', 'win')) as withdrawal_count,
sum(case when transaction_type in ('deposit', 'bonus') then amount else 0 end) / (sum(case when transaction_type in ('withdrawal', 'win') then amount else 0 end) + 1) as deposit_withdrawal_ratio,
sum(case when transaction_type in ('deposit', 'bonus') then amount else 0 end) - sum(case when transaction_type in ('withdrawal', 'win') then amount else 0 end) as net_deposits from tx group by user_id""", (v.TX,), "deposit_sum withdrawal_sum deposit_withdrawal_ratio net_deposits")
def deposit_withdrawal(spark, sf):
    return ops.deposit_withdrawal(v.transactions(spark, sf))


@query("select user_id, round(avg(bet_amount), 4) bet_amount_mean, round(stddev_samp(bet_amount), 4) bet_amount_std, round(min(bet_amount), 4) bet_amount_min, round(max(bet_amount), 4) bet_amount_max, round(avg(games_played), 4) games_played_mean, round(stddev_samp(games_played), 4) games_played_std, round(min(games_played)::double, 4) games_played_min, round(max(games_played)::double, 4) games_played_max from bets group by user_id", (v.BETS,))
def user_aggregates(spark, sf):
    return ops.user_aggregates(v.bets(spark, sf), ["bet_amount", "games_played"])


@query(""", a as (select string_agg(x, ',' order by x) as d from (select transaction_type || ':' || count(*) as x from tx group by transaction_type)), b as (select string_agg(x, ',' order by x) as d from (select status || ':' || count(*) as x from tx group by status))
select count(*) as total_transactions, count(distinct user_id) as unique_users, sum(amount) as total_amount, avg(amount) as avg_amount, min(created_at) as oldest, max(created_at) as newest, any_value(a.d) as transaction_type_distribution, any_value(b.d) as status_distribution from tx, a, b""", (v.TX,), "total_amount avg_amount")
def transaction_stats(spark, sf):
    out = ops.transaction_stats(v.transactions(spark, sf))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest", "newest")})


@query(f"select count(*) as rows, count(distinct user_id) as users, sum(amount) as total, avg(amount) as mean, min(created_at) as oldest, max(created_at) as newest, count(*) filter (where created_at >= {_AS_OF} - interval 24 hours) as last_24h from tx", (v.TX,), "total mean")
def table_stats(spark, sf):
    out = ops.table_stats(v.transactions(spark, sf), v.EVENTS_AS_OF)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest", "newest")})


@query("""select transaction_id, cast(hour(created_at) as int) as hour, cast(isodow(created_at) - 1 as int) as weekday, cast(isodow(created_at) >= 6 as int) as is_weekend, cast(month(created_at) as int) as month, cast(quarter(created_at) as int) as quarter, cast(day(created_at) as int) as day, cast(weekofyear(created_at) as int) as week, cast(hour(created_at) between 9 and 17 as int) as is_business_hours, cast(hour(created_at) between 19 and 23 as int) as is_peak_hours, case when hour(created_at) <= 6 then 'night' when hour(created_at) <= 12 then 'morning' when hour(created_at) <= 18 then 'afternoon' else 'evening' end as period,
case when hour(created_at) < 6 then 'madrugada' when hour(created_at) < 12 then 'manha' when hour(created_at) < 18 then 'tarde' else 'noite' end as time_slot from tx""", (v.TX,))
def temporal_row_features(spark, sf):
    return ops.temporal_row_features(v.transactions(spark, sf)).select("transaction_id", "hour", "weekday", "is_weekend", "month", "quarter", "day", "week", "is_business_hours", "is_peak_hours", "period", "time_slot")


_MODE = "select user_id, x from (select user_id, {0} as x, row_number() over (partition by user_id order by count(*) desc, {0}) k from tx group by user_id, {0}) where k = 1"


@query(f""", h as ({_MODE.format('hour(created_at)')}), w as ({_MODE.format('isodow(created_at) - 1')}),
s as ({_MODE.format("case when hour(created_at) < 6 then 'madrugada' when hour(created_at) < 12 then 'manha' when hour(created_at) < 18 then 'tarde' else 'noite' end")}),
m as (select user_id, string_agg(cast(d as varchar), ',' order by d) as days from (select user_id, isodow(created_at) - 1 as d, rank() over (partition by user_id order by count(*) desc) k from tx group by 1, 2) where k = 1 group by user_id)
select tx.user_id, cast(any_value(h.x) as int) as preferred_hour, cast(any_value(w.x) as int) as preferred_weekday, any_value(s.x) as preferred_slot, avg(case when isodow(created_at) >= 6 then 1.0 else 0.0 end) as weekend_ratio, any_value(m.days) as modal_weekdays
from tx join h on h.user_id = tx.user_id join w on w.user_id = tx.user_id join s on s.user_id = tx.user_id join m on m.user_id = tx.user_id group by tx.user_id""", (v.TX,), "weekend_ratio")
def temporal_preferences(spark, sf):
    return ops.temporal_preferences(v.transactions(spark, sf))


@query(""", g as (select user_id, floor((epoch(created_at) - epoch(lag(created_at) over (partition by user_id order by created_at, transaction_id))) / 86400) as gap from tx)
select user_id, stddev_samp(gap) as activity_regularity, count(gap) as gaps from g group by user_id""", (v.TX,), "activity_regularity")
def activity_regularity(spark, sf):
    return ops.activity_regularity(v.transactions(spark, sf))


@query(""", u as (select user_id, count(*)::double n, sum(amount) as total, count(distinct game_type)::double as games from tx group by user_id),
s as (select avg(n) an, stddev_pop(n) sn, avg(total) atot, stddev_pop(total) st, avg(games) ag, stddev_pop(games) sg from u)
select user_id, ((n - an) / case when sn > 0 then sn else 1 end + (total - atot) / case when st > 0 then st else 1 end + (games - ag) / case when sg > 0 then sg else 1 end) / 3 as engagement_score from u, s""", (v.TX,), "engagement_score")
def zscore_composite(spark, sf):
    per_user = v.transactions(spark, sf).groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.sum("amount").alias("total"), F.countDistinct("game_type").cast("double").alias("games"))
    return ops.zscore_composite(per_user, ["n", "total", "games"], "engagement_score").select("user_id", "engagement_score")


@query(""", s as (select avg(amount) a, stddev_pop(amount) d from tx), c as (select channel, row_number() over (order by channel) - 1 as code from (select distinct channel from tx))
select transaction_id, c.code as channel_encoded, (amount - a) / case when d > 0 then d else 1 end as amount_normalized from tx join c on c.channel = tx.channel, s""", (v.TX,), "amount_normalized")
def encode_normalize(spark, sf):
    return ops.encode_normalize(v.transactions(spark, sf), ["channel"], ["amount"]).select("transaction_id", "channel_encoded", "amount_normalized")


@query(""", x as (select 'bet_amount' as feature, var_samp(bet_amount) as variance from bets union all select 'games_played', var_samp(games_played) from bets union all select 'session_duration', var_samp(session_duration) from bets)
select feature, variance, variance / (select max(variance) from x) as importance from x""", (v.BETS,), "variance importance")
def variance_importance(spark, sf):
    return ops.variance_importance(v.bets(spark, sf), ["bet_amount", "games_played", "session_duration"])


@query("select transaction_id, user_id, sum(case when transaction_type in ('deposit', 'win') then amount else -amount end) over (partition by user_id order by created_at, transaction_id rows unbounded preceding) as balance from tx", (v.TX,), "balance")
def running_balance(spark, sf):
    return ops.running_balance(v.transactions(spark, sf))


@query("select transaction_id, user_id, amount, amount >= 100 and status = 'completed' as is_hot, amount > 300 as is_suspicious, amount > 200 as needs_kyc from tx", (v.TX,), "amount")
def flag_transactions(spark, sf):
    return ops.flag_transactions(v.transactions(spark, sf), hot=100.0, suspicious=300.0, kyc=200.0)


@query(""", a as (select user_id, cast(created_at as date) as day, count(*) as n, sum(amount) as total from tx where transaction_type = 'deposit' group by 1, 2), b as (select user_id, cast(created_at as date) as day, count(*) as n, sum(amount) as total from tx where transaction_type = 'win' group by 1, 2)
select user_id, day, a.n as n_dl, a.total as total_dl, b.n as n_tx, b.total as total_tx from a full join b using (user_id, day)""", (v.TX,), "total_dl total_tx")
def merge_sources(spark, sf):
    tx = v.transactions(spark, sf)
    side = lambda kind: tx.where(F.col("transaction_type") == kind).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return ops.merge_sources(side("deposit"), side("win"), ["user_id", "day"])


@query(""", w as (select user_id, avg(amount) as ticket_mean, max(amount) as ticket_max, count(*)::double as ticket_count from tx group by user_id)
select user_id, 'ticket_mean' as feature_name, ticket_mean as feature_value from w union all select user_id, 'ticket_max', ticket_max from w union all select user_id, 'ticket_count', ticket_count from w""", (v.TX,), "feature_value")
def features_to_long(spark, sf):
    return ops.features_to_long(ops.ticket_stats(v.transactions(spark, sf)), "user_id", ["ticket_mean", "ticket_max", "ticket_count"])


@query("select user_id, avg(amount) as ticket_mean, max(amount) as ticket_max, count(*)::double as ticket_count from tx group by user_id", (v.TX,), "ticket_mean ticket_max ticket_count")
def features_to_wide(spark, sf):
    names = ["ticket_mean", "ticket_max", "ticket_count"]
    long = ops.features_to_long(ops.ticket_stats(v.transactions(spark, sf)), "user_id", names)
    return ops.features_to_wide(long, "user_id", names)


@query(""", f as (select user_id, created_at as ts, max(amount) as value from tx where transaction_type = 'deposit' group by 1, 2), s as (select distinct user_id, created_at as t0 from tx where transaction_type = 'win'),
j as (select s.user_id, s.t0, f.ts, f.value from s asof left join f on s.user_id = f.user_id and s.t0 >= f.ts)
select user_id, t0 as "at", case when ts >= t0 - interval 3 days then ts end as feature_ts, case when ts >= t0 - interval 3 days then value end as value from j""", (v.TX,), "value")
def features_asof(spark, sf):
    tx = v.transactions(spark, sf)
    features = tx.where("transaction_type = 'deposit'").groupBy("user_id", F.col("created_at").alias("ts")).agg(F.max("amount").alias("value"))
    spine = tx.where("transaction_type = 'win'").select("user_id", F.col("created_at").alias("at")).distinct()
    out = ops.features_asof(spine, features, "3 days")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "feature_ts")})
