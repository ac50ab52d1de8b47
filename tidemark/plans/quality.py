"""Queries of cleaning and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import cleaning as c
from ..operators import quality as q
from . import views as v
from .registry import query

_AT = "timestamp '2024-01-31 00:00:00'"
#: Defects that the stored events lack: null users and amounts, doubled keys, outliers, texts to be cleaned.
_DIRTY = """, dirty as (select transaction_id, case when transaction_id % 97 = 0 then null else user_id end as user_id, case when transaction_id % 53 = 0 then null when transaction_id % 101 = 0 then amount * 1000 when transaction_id % 103 = 0 then -amount else amount end as amount,
case when transaction_id % 31 = 0 then date_trunc('day', created_at) else created_at end as created_at, case when transaction_id % 41 = 0 then null else game_type end as game_type, case when transaction_id % 43 = 0 then null else device end as device, status from tx)"""


def _dirty(spark, sf):
    i = F.col("transaction_id")
    return v.transactions(spark, sf).select(
        "transaction_id", F.when(i % 97 != 0, F.col("user_id")).alias("user_id"),
        F.when(i % 53 == 0, None).when(i % 101 == 0, F.col("amount") * 1000).when(i % 103 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(i % 31 == 0, F.date_trunc("day", "created_at")).otherwise(F.col("created_at")).alias("created_at"), F.when(i % 41 != 0, F.col("game_type")).alias("game_type"), F.when(i % 43 != 0, F.col("device")).alias("device"), "status")


@query(_DIRTY + " select transaction_id from dirty where user_id is not null", (v.TX,))
def require_key(spark, sf):
    return c.require_key(_dirty(spark, sf)).select("transaction_id")


@query(_DIRTY + " select distinct user_id, game_type, device, status from dirty", (v.TX,))
def dedup_exact(spark, sf):
    return c.dedup_exact(_dirty(spark, sf).select("user_id", "game_type", "device", "status"))


@query(_DIRTY + " select transaction_id, user_id from (select *, row_number() over (partition by user_id, created_at order by transaction_id desc) n from dirty) where n = 1", (v.TX,))
def dedup_key(spark, sf):
    return c.dedup_key(_dirty(spark, sf), ["user_id", "created_at"], [F.desc("transaction_id")]).select("transaction_id", "user_id")


@query(_DIRTY + """, m as (select device from dirty where device is not null group by device order by count(*) desc, device limit 1)
select transaction_id, coalesce(amount, 0) as amount, coalesce(game_type, 'unknown') as game_type, coalesce(dirty.device, m.device) as device from dirty, m""", (v.TX,), "amount")
def fill_missing(spark, sf):
    return c.fill_missing(_dirty(spark, sf), v.EVENTS_AS_OF, skip=("user_id", "transaction_id")).select("transaction_id", "amount", "game_type", "device")


@query("""select c_custkey, trim(regexp_replace(regexp_replace(c_name || ' (' || c_mktsegment || ')! ', '[^\\w\\s@.-]', '', 'g'), '\\s+', ' ', 'g')) as name, replace(lower(trim(regexp_replace(c_mktsegment || ' Zone', '[^\\w\\s@.-]', '', 'g'))), ' ', '_') as game_type, regexp_replace('+(' || c_custkey || ') 555-01', '[^\\d+]', '', 'g') as phone from customer""")
def standardize_strings(spark, sf):
    rows = v.table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")! ")).alias("name"), F.concat("c_mktsegment", F.lit(" Zone")).alias("game_type"), F.concat(F.lit("+("), "c_custkey", F.lit(") 555-01")).alias("phone"))
    return c.standardize_strings(rows, ["name", "game_type", "phone"])


@query("select event_id, case when event_type = 'view' then 'USD' when event_type = 'click' then 'BRL' else upper(event_type) end as currency from events")
def standardize_currency(spark, sf):
    from ..functions.text import currency

    raw = F.when(F.col("event_type") == "view", " Dollar ").when(F.col("event_type") == "click", "R$").otherwise(F.col("event_type"))
    return v.table(spark, sf, "events").select("event_id", currency(raw).alias("currency"))


@query("select doc_id, try_cast(left(text, 1) as int) as first_digit, try_cast(lang as double) as lang_number from documents", (), "lang_number")
def coerce_types(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 1).alias("first_digit"), F.col("lang").alias("lang_number"))
    return c.coerce_types(rows, {"first_digit": "int", "lang_number": "double"})


@query(_DIRTY + ", b as (select quantile_cont(amount, 0.25) a, quantile_cont(amount, 0.75) b from dirty) select transaction_id from dirty, b where amount is null or amount between b.a - 1.5 * (b.b - b.a) and b.b + 1.5 * (b.b - b.a)", (v.TX,))
def filter_iqr(spark, sf):
    return c.filter_iqr(_dirty(spark, sf), ["amount"]).select("transaction_id")


@query(_DIRTY + ", b as (select avg(amount) m, stddev_pop(amount) s from dirty) select transaction_id from dirty, b where amount is null or abs(amount - m) <= 3 * s", (v.TX,))
def filter_zscore(spark, sf):
    return c.filter_zscore(_dirty(spark, sf), ["amount"]).select("transaction_id")


def _step(source, column):
    return f"select s.* from {source} s, (select quantile_cont({column}, 0.25) a, quantile_cont({column}, 0.75) b, avg({column}) m, stddev_pop({column}) d from {source}) q where {column} is null or ({column} between a - 1.5 * (b - a) and b + 1.5 * (b - a) and abs({column} - m) <= 3 * d)"


@query(f", s1 as ({_step('bets', 'bet_amount')}), s2 as ({_step('s1', 'win_amount')}) select event_id from s2", (v.BETS,))
def handle_outliers(spark, sf):
    return c.handle_outliers(v.bets(spark, sf), ["bet_amount", "win_amount"]).select("event_id")


@query(_DIRTY + " select transaction_id from dirty where amount between 0.01 and 100000", (v.TX,))
def filter_amount(spark, sf):
    return c.filter_amount(_dirty(spark, sf)).select("transaction_id")


_MAIL = "regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0)"


@query(f"select doc_id, case when regexp_matches({_MAIL}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') then {_MAIL} else 'invalid@unknown.com' end as email from documents")
def validate_email(spark, sf):
    return c.validate_email(v.table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0).alias("email")))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'unknown' else '+55 11 ' || (c_custkey + 1000000) end as phone from customer")
def validate_phone(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, "12-34").otherwise(F.concat(F.lit("+55 11 "), F.col("c_custkey") + 1000000))
    return c.validate_phone(v.table(spark, sf, "customer").select("c_custkey", raw.alias("phone")))


@query("select transaction_id from tx where created_at between timestamp '2020-01-01' and timestamp '2024-01-16'", (v.TX,))
def filter_dates(spark, sf):
    return c.filter_dates(v.transactions(spark, sf), dt.datetime(2024, 1, 15)).select("transaction_id")


@query("select transaction_id from tx where user_id in (select user_id from tx group by 1 having count(*) >= 70)", (v.TX,))
def filter_active_users(spark, sf):
    return c.filter_active_users(v.transactions(spark, sf), 70).select("transaction_id")


@query(f"select transaction_id from tx where created_at >= {_AT} - interval 5 days", (v.TX,))
def filter_recent(spark, sf):
    return c.filter_recent(v.transactions(spark, sf), v.EVENTS_AS_OF, 5).select("transaction_id")


@query(_DIRTY + f""", s1 as (select * from dirty where user_id is not null), s3 as (select * exclude n from (select *, row_number() over (partition by user_id, created_at order by transaction_id desc) n from s1) where n = 1), s4 as (select * replace (coalesce(amount, 0) as amount) from s3), s5 as (select * from s4 where amount between 0.01 and 100000), s6 as (select * from s5 where created_at between timestamp '2020-01-01' and {_AT} + interval 1 day), s7 as ({_step('s6', 'amount')}),
n as (select 0 i, 'input' as step, count(*) as rows from dirty union all select 1, 'key', count(*) from s1 union all select 2, 'exact_duplicates', count(*) from s1 union all select 3, 'key_duplicates', count(*) from s3 union all select 4, 'missing', count(*) from s4 union all select 5, 'amounts', count(*) from s5 union all select 6, 'dates', count(*) from s6 union all select 7, 'outliers', count(*) from s7)
select step, rows, coalesce(lag(rows) over (order by i) - rows, 0) as removed from n""", (v.TX,))
def clean_report(spark, sf):
    return c.clean(_dirty(spark, sf), v.EVENTS_AS_OF)[1]


@query()
def clean_quality(spark, sf):
    return c.clean_quality(*c.clean(_dirty(spark, sf), v.EVENTS_AS_OF))


@query(_DIRTY + """, s as (select count(*) as rows, (5 * count(*) - count(user_id) - count(amount) - count(game_type) - count(device) - count(created_at) + 2 * count(*) - count(status) - count(transaction_id)) / (7 * count(*)) as null_share, 1 - count(distinct (user_id, created_at)) / count(*) as duplicate_share from dirty)
select *, cast(null_share > 0.05 as int) + cast(duplicate_share > 0.02 as int) + cast(rows = 0 as int) as issues, true as valid from s""", (v.TX,), "null_share duplicate_share")
def validate_cleaned(spark, sf):
    return c.validate_cleaned(_dirty(spark, sf), ["user_id", "created_at"])


@query()
def ml_ready(spark, sf):
    return c.ml_ready(_dirty(spark, sf).where("user_id is not null"), drop=("created_at",))


_SEV = "select '{0}' as rule, '{1}' as severity, ({2})::double as score, {3} as passed from {4}"


def _rules(source, *rules):
    return " union all ".join(_SEV.format(n, s, x, p, source) for n, s, x, p in rules)


@query(_DIRTY + ", k as (select count(user_id) / count(*) u, count(amount) / count(*) a, count(game_type) / count(*) g from dirty) " + _rules("k", ("completeness", "high", "(u + a + g) / 3", "(u + a + g) / 3 >= 0.95"), ("completeness_user_id", "critical", "u", "u >= 1"), ("completeness_amount", "medium", "a", "a >= 0.95"), ("completeness_game_type", "medium", "g", "g >= 0.95")), (v.TX,), "score")
def check_completeness(spark, sf):
    return q.check_completeness(_dirty(spark, sf), ["user_id", "amount", "game_type"], ("user_id",))


@query(_DIRTY + ", k as (select count(*) n, count(*) filter (where user_id is null) + count(user_id) - count(distinct user_id) as bad from dirty) " + _rules("k", ("primary_key", "critical", "1 - bad / n", "bad = 0")), (v.TX,), "score")
def check_primary_key(spark, sf):
    return q.check_primary_key(_dirty(spark, sf), "user_id")


@query(f", k as (select (epoch({_AT}) - epoch(max(created_at))) / 3600 as age from tx) " + _rules("k", ("freshness", "high", "greatest(0, 1 - age / 48)", "age <= 24")), (v.TX,), "score")
def check_freshness(spark, sf):
    return q.check_freshness(v.transactions(spark, sf), "created_at", v.EVENTS_AS_OF)


@query(_DIRTY + ", k as (select 1 - count(distinct (user_id, game_type, device, status)) / count(*) e, 1 - count(distinct (user_id, game_type)) / count(*) x from dirty) " + _rules("k", ("duplicates_exact", "medium", "1 - e", "e <= 0.02"), ("duplicates_key", "high", "1 - x", "x <= 0.02")), (v.TX,), "score")
def check_duplicates(spark, sf):
    return q.check_duplicates(_dirty(spark, sf).select("user_id", "game_type", "device", "status"), ["user_id", "game_type"])


@query(_DIRTY + ", b as (select quantile_cont(amount, 0.25) a, quantile_cont(amount, 0.75) b from dirty), k as (select count(*) filter (where amount not between b.a - 1.5 * (b.b - b.a) and b.b + 1.5 * (b.b - b.a)) / count(amount) r from dirty, b) " + _rules("k", ("outliers_amount", "medium", "1 - r", "r <= 0.05")), (v.TX,), "score")
def check_outliers(spark, sf):
    return q.check_outliers(_dirty(spark, sf), ["amount"])


@query("with k as (select count(*) filter (where try_cast(event_id::varchar as bigint) is not null) / count(event_id) as e, count(*) filter (where value = floor(value)) / count(value) as x, count(*) filter (where try_cast(event_type as double) is not null) / count(event_type) as t from events) " + _rules("k", ("type_event_id", "high", "e", "e >= 1"), ("type_value", "high", "x", "x >= 1"), ("type_event_type", "high", "t", "t >= 1")), (), "score")
def check_types(spark, sf):
    return q.check_types(v.table(spark, sf, "events"), {"event_id": "bigint", "value": "int", "event_type": "double"})


@query(_DIRTY + ", k as (select count(*) filter (where amount between 0.01 and 100000) / count(*) a, count(*) filter (where device in ('mobile', 'desktop')) / count(*) d from dirty) " + _rules("k", ("amount_range", "high", "a", "a = 1"), ("allowed_device", "medium", "d", "d = 1")), (v.TX,), "score")
def check_business_rules(spark, sf):
    return q.check_business_rules(_dirty(spark, sf), "amount", 0.01, 100000.0, {"device": ["mobile", "desktop"]})


@query(", k as (select count(*) filter (where session_duration between 0 and 2000) / count(session_duration) s, count(*) filter (where games_played between 1 and 9) / count(games_played) g from bets) " + _rules("k", ("range_session_duration", "medium", "s", "s >= 0.99"), ("range_games_played", "medium", "g", "g >= 0.99")), (v.BETS,), "score")
def check_ranges(spark, sf):
    return q.check_ranges(v.bets(spark, sf), {"session_duration": (0, 2000), "games_played": (1, 9)})


@query(", m as (select bet_amount x, avg(bet_amount) over () mu from bets), k as (select cast(abs(avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5)) > 5 as int) + cast(abs(avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3) > 10 as int) + cast(var_samp(x) < 0.01 as int) as bad from m) " + _rules("k", ("distribution_bet_amount", "low", "1 - bad / 3", "bad = 0")), (v.BETS,), "score")
def check_distribution(spark, sf):
    return q.check_distribution(v.bets(spark, sf), ["bet_amount"])


@query(", k as (select abs(corr(bet_amount, win_amount)) a, abs(corr(bet_amount, games_played)) b, abs(corr(win_amount, games_played)) c from bets) " + _rules("k", ("correlation_bet_amount_win_amount", "low", "1 - a", "a <= 0.95"), ("correlation_bet_amount_games_played", "low", "1 - b", "b <= 0.95"), ("correlation_win_amount_games_played", "low", "1 - c", "c <= 0.95")), (v.BETS,), "score")
def check_correlation(spark, sf):
    return q.check_correlation(v.bets(spark, sf), ["bet_amount", "win_amount", "games_played"])


@query(", k as (select least(1, count(distinct bet_amount) / count(*) / 0.01) u, count(distinct bet_amount) / count(*) >= 0.01 and (max(bet_amount) - min(bet_amount)) / stddev_samp(bet_amount) <= 1000 p, (select min(n) from (select count(*) n from bets group by game_type)) m from bets) " + _rules("k", ("ml_features", "high", "0.2", "false"), ("ml_classes", "high", "least(1, m / 10)", "m >= 10"), ("ml_bet_amount", "medium", "u", "p")), (v.BETS,), "score")
def check_ml_readiness(spark, sf):
    return q.check_ml_readiness(v.bets(spark, sf), ["bet_amount"], "game_type")


@query(_DIRTY + f""", k as (select count(user_id) / count(*) u, count(amount) / count(*) a, (epoch({_AT}) - epoch(max(created_at))) / 3600 age from dirty),
r as ({_rules("k", ("completeness", "high", "(u + a) / 2", "(u + a) / 2 >= 0.95"), ("completeness_user_id", "critical", "u", "u >= 1"), ("completeness_amount", "medium", "a", "a >= 0.95"), ("freshness", "high", "greatest(0, 1 - age / 48)", "age <= 24"))}),
w as (select *, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end w from r), o as (select sum(w * score) / sum(w) as overall_score, count(*) as rules, count(*) filter (where passed) as passed_rules, count(*) filter (where severity = 'critical' and not passed) as critical_issues from w)
select *, case when overall_score >= 0.95 then 'A' when overall_score >= 0.85 then 'B' when overall_score >= 0.75 then 'C' when overall_score >= 0.6 then 'D' else 'F' end as grade, critical_issues = 0 and overall_score >= 0.75 as passed from o""", (v.TX,), "overall_score")
def run_suite(spark, sf):
    rows = _dirty(spark, sf)
    return q.run_suite([q.check_completeness(rows, ["user_id", "amount"], ("user_id",)), q.check_freshness(rows, "created_at", v.EVENTS_AS_OF)])


@query(_DIRTY + f""", d as (select (count(user_id) + count(amount) + count(game_type)) / (3 * count(*)) as completeness, count(*) filter (where amount >= 0) / count(*) as accuracy, count(*) filter (where created_at <= {_AT}) / count(*) as consistency, greatest(0, 1 - (epoch({_AT}) - epoch(max(created_at))) / 3600 / 48) as timeliness, count(distinct transaction_id) / count(*) as uniqueness, count(*) filter (where amount is not null) / count(*) as validity from dirty),
s as (select *, completeness * 0.25 + accuracy * 0.2 + consistency * 0.15 + timeliness * 0.15 + uniqueness * 0.15 + validity * 0.1 as score from d) select *, case when score >= 0.95 then 'A' when score >= 0.85 then 'B' when score >= 0.75 then 'C' when score >= 0.6 then 'D' else 'F' end as grade from s""", (v.TX,), "completeness accuracy consistency timeliness uniqueness validity score")
def quality_dimensions(spark, sf):
    return q.quality_dimensions(_dirty(spark, sf), v.EVENTS_AS_OF, ["user_id", "amount", "game_type"], "transaction_id", "created_at", "amount")


@query(" select count(*) as rows, count(*) / 5000.0::double as ratio, case when count(*) / 5000 < 0.8 then 'low' when count(*) / 5000 > 2 then 'high' else 'none' end as anomaly from tx", (v.TX,), "ratio")
def volume_anomaly(spark, sf):
    return q.volume_anomaly(v.transactions(spark, sf), 5000.0)


@query("select 'channel' as \"column\", 'missing' as kind, 'critical' as severity, 0::bigint as filled union all select 'props', 'extra', 'medium', count(props) from events having count(props) > 0")
def schema_drift(spark, sf):
    return q.schema_drift(v.table(spark, sf, "events"), ["event_id", "ts", "user_id", "event_type", "value", "channel"])


@query(_DIRTY + """, s as (select count(*) as rows, count(*) filter (where user_id is null) as null_keys, count(*) filter (where amount < 0) as negative, count(*) filter (where amount is null) as null_amounts from dirty)
select *, case when rows = 0 then 'critical' when cast(null_keys > 0 as int) + cast(negative > 0 as int) + cast(null_amounts > 0 as int) = 0 then 'good' when cast(null_keys > 0 as int) + cast(negative > 0 as int) + cast(null_amounts > 0 as int) = 1 then 'warnings' else 'critical' end as status from s""", (v.TX,))
def extract_quality(spark, sf):
    return q.extract_quality(_dirty(spark, sf))


@query(""", l as (select 'bet_amount' as feature, bet_amount x, timestamp < timestamp '2024-01-15' as ref from bets union all select 'session_duration', session_duration * case when timestamp < timestamp '2024-01-15' then 1 else 3 end, timestamp < timestamp '2024-01-15' from bets),
s as (select feature, avg(x) filter (where ref) m0, stddev_samp(x) filter (where ref) s0, avg(x) filter (where not ref) m1 from l group by feature), d as (select feature, coalesce(least(1, abs(m1 - m0) / s0 / 3), 0) as drift from s)
select feature, drift, case when drift > 0.7 then 'critical' when drift > 0.5 then 'high' when drift > 0.3 then 'medium' else 'none' end as severity, false as null_drift from d""", (v.BETS,), "drift")
def drift(spark, sf):
    rows = v.bets(spark, sf)
    early = F.col("timestamp") < F.lit(dt.datetime(2024, 1, 15))
    return q.drift(rows.where(early), rows.where(~early).withColumn("session_duration", F.col("session_duration") * 3), ["bet_amount", "session_duration"])


@query(""", h as (select date_trunc('hour', created_at) as hour, count(*) as n from tx group by 1), b as (select hour, n, avg(n) over w as baseline, count(*) over w as seen from h window w as (order by hour range between interval 7 days preceding and interval 1 second preceding))
select hour, n, baseline, seen > 0 and n > 1.5 * baseline as alert from b""", (v.TX,), "baseline")
def hourly_alerts(spark, sf):
    return q.hourly_alerts(v.transactions(spark, sf), 1.5).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(""", d as (select cast(created_at as date) as day, avg(case when status = 'failed' then 1.0 else 0.0 end) as rate from tx group by 1)
select day, rate, count(*) filter (where rate > 0.1) over w = 2 as firing from d window w as (order by day rows between 1 preceding and current row)""", (v.TX,), "rate")
def failure_alerts(spark, sf):
    return q.failure_alerts(v.transactions(spark, sf), 0.1)


@query(" select least(avg(amount) + 2 * stddev_samp(amount), 200) as threshold from tx", (v.TX,), "threshold")
def adaptive_threshold(spark, sf):
    return q.adaptive_threshold(v.transactions(spark, sf), "amount", 100.0)


@query(" select channel, count(*) as n, count(*) / (select count(*) from tx where status = 'failed') as share, count(*) / (select count(*) from tx where status = 'failed') > 0.7 as dominant from tx where status = 'failed' group by channel", (v.TX,), "share")
def dominant_error(spark, sf):
    return q.dominant_error(v.transactions(spark, sf).where("status = 'failed'"), "channel")


@query(" select channel, count(*) as n, avg(delay_hours) as mean, quantile_cont(delay_hours, 0.95) as p95, quantile_cont(delay_hours, 0.99) as p99, avg(case when interaction_type = 'support_ticket' then 1.0 else 0.0 end) as error_rate, count(*) / nullif(epoch(max(timestamp)) - epoch(min(timestamp)), 0) as throughput from inter group by channel", (v.INTER,), "mean p95 p99 error_rate throughput")
def latency_summary(spark, sf):
    return q.latency_summary(v.interactions(spark, sf), "channel", "delay_hours", "interaction_type = 'support_ticket'", "timestamp")


@query(" select channel, time_bucket(interval 5 minutes, created_at) as start, count(*) as n, avg(amount) as mean, min(amount) as low, max(amount) as high from tx group by 1, 2", (v.TX,), "mean low high")
def metrics_summary(spark, sf):
    return q.metrics_summary(v.transactions(spark, sf), "created_at", "channel", "amount").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(", p(channel, days) as (values ('email', 10), ('sms', 20), ('push', 5)) select tx.channel, count(*) as rows, count(*) filter (where created_at < timestamp '2024-01-31' - to_days(days)) as violations from tx join p on p.channel = tx.channel group by tx.channel", (v.TX,))
def retention_violations(spark, sf):
    policy = spark.createDataFrame([("email", 10), ("sms", 20), ("push", 5)], "channel string, days int")
    return q.retention_violations(v.transactions(spark, sf), "created_at", policy, "channel", v.EVENTS_AS_OF)


@query(" select transaction_id from tx where user_id % 7 <> 0 or transaction_type = 'deposit'", (v.TX,))
def erase_subjects(spark, sf):
    rows = v.transactions(spark, sf).withColumn("keep", F.col("transaction_type") == "deposit")
    return q.erase_subjects(rows, rows.where("user_id % 7 = 0").select("user_id"), "user_id", "keep")[0].select("transaction_id")


@query(", h as (select channel as source, cast(created_at as date) as ts, count(*)::double as volume, avg(amount) as score from tx group by 1, 2), r as (select *, row_number() over (partition by source order by ts desc) n from h) select source, count(*) as checks, avg(volume) as mean_volume, stddev_samp(volume) as std_volume, avg(score) as mean_score, stddev_samp(score) as std_score from r where n <= 10 group by source", (v.TX,), "mean_volume std_volume mean_score std_score")
def quality_baseline(spark, sf):
    days = v.transactions(spark, sf).groupBy(F.col("channel").alias("source"), F.to_date("created_at").alias("ts")).agg(F.count("*").cast("double").alias("volume"), F.avg("amount").alias("score"))
    return q.quality_baseline(days, 10)


_ALERTS = f"""with recursive {v.TX}, low as (select distinct channel as dimension, case when amount / 100 < 0.63 then 'critical' when amount / 100 < 0.765 then 'high' else 'medium' end as severity, created_at as ts from tx where amount / 100 < 0.9),
nxt as (select *, min(ts) over (partition by dimension, severity order by ts range between interval 15 minutes following and unbounded following) as later from low),
a as (select dimension, severity, min(ts) as ts from low group by 1, 2 union all select n.dimension, n.severity, n.later from a join nxt n on n.dimension = a.dimension and n.severity = a.severity and n.ts = a.ts where n.later is not null)
select dimension, severity, ts from a"""


@query(_ALERTS)
def quality_alerts(spark, sf):
    metrics = v.transactions(spark, sf).select(F.col("channel").alias("dimension"), F.col("created_at").alias("ts"), (F.col("amount") / 100).alias("score"))
    return q.quality_alerts(metrics).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
