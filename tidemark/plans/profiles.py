"""Queries over bets and interactions: one row per user."""

from __future__ import annotations

from ..operators import profiles as ops
from . import views as v
from .registry import query

_W = "over (partition by user_id order by timestamp, event_id)"
_R = "over (partition by user_id order by timestamp, event_id rows between {} preceding and current row)"
_E = "(({}) + 1e-8)"


@query(""", m as (select *, avg(bet_amount) over (partition by user_id) mu from bets)
select user_id, sum(bet_amount) as total_wagered, avg(bet_amount) as avg_bet, max(bet_amount) as max_bet, min(bet_amount) as min_bet, stddev_samp(bet_amount) as bet_std, stddev_samp(bet_amount) / (avg(bet_amount) + 1e-8) as bet_cv,
avg(power(bet_amount - mu, 3)) / power(avg(power(bet_amount - mu, 2)), 1.5) as bet_skewness, avg(power(bet_amount - mu, 4)) / power(avg(power(bet_amount - mu, 2)), 2) - 3 as bet_kurtosis,
case when avg(bet_amount) >= 10000 then 3 when avg(bet_amount) >= 1000 then 2 else 1 end as user_tier, quantile_cont(bet_amount, 0.25) as bet_p25, quantile_cont(bet_amount, 0.5) as median_bet, quantile_cont(bet_amount, 0.75) as bet_p75, quantile_cont(bet_amount, 0.9) as bet_p90, quantile_cont(bet_amount, 0.95) as bet_p95,
max(bet_amount) / (avg(bet_amount) + 1e-8) as max_bet_ratio, quantile_cont(bet_amount, 0.95) / (avg(bet_amount) + 1e-8) as p95_avg_ratio from m group by user_id""", (v.BETS,),
       "total_wagered avg_bet max_bet min_bet bet_std bet_cv bet_skewness bet_kurtosis bet_p25 median_bet bet_p75 bet_p90 bet_p95 max_bet_ratio p95_avg_ratio")
def spending(spark, sf):
    return ops.spending(v.bets(spark, sf))


@query(""", r as (select user_id, bet_amount, min(bet_amount) over (partition by user_id) lo, max(bet_amount) over (partition by user_id) hi from bets),
b as (select user_id, case when hi > lo then greatest(1, least(5, ceil((bet_amount - lo) / (hi - lo) * 5))) else 1 end as bin, count(*) n from r group by 1, 2), t as (select user_id, sum(n) total from b group by 1)
select b.user_id, sum((n / total) * (n / total)) as spending_concentration from b join t on t.user_id = b.user_id group by b.user_id""", (v.BETS,), "spending_concentration")
def spending_concentration(spark, sf):
    return ops.spending_concentration(v.bets(spark, sf))


@query(""", a as (select user_id, sum(case when deposit_amount > 0 then deposit_amount end) td, avg(case when deposit_amount > 0 then deposit_amount end) ad, count(case when deposit_amount > 0 then 1 end) n, max(case when deposit_amount > 0 then deposit_amount end) md, stddev_samp(case when deposit_amount > 0 then deposit_amount end) sd, sum(bet_amount) sb, avg(bet_amount) ab, avg(case when win_amount > 0 then 1.0 else 0.0 end) w from bets group by user_id)
select user_id, td as total_deposits, ad as avg_deposit, n as deposit_frequency, md as max_deposit, sd / (ad + 1e-8) as deposit_cv, sb / (td + 1e-8) as bet_deposit_ratio, ab / (ad + 1e-8) as bet_sizing_ratio, case when w > 0 and w < 1 then abs(ab / (ad + 1e-8) - greatest(0, 2 * w - 1)) end as kelly_deviation from a""", (v.BETS,), "total_deposits avg_deposit max_deposit deposit_cv bet_deposit_ratio bet_sizing_ratio kelly_deviation")
def bankroll(spark, sf):
    return ops.bankroll(v.bets(spark, sf))


@query(f""", r as (select user_id, bet_amount, row_number() {_W} n, stddev_samp(bet_amount) {_R.format(9)} s, stddev_samp(win_amount - bet_amount) {_R.format(9)} p from bets), x as (select *, case when n >= 10 then s end as vol, case when n >= 10 then p end as pvol from r)
select user_id, avg(vol) as avg_volatility, max(vol) as max_volatility, avg(vol) / (avg(bet_amount) + 1e-8) as normalized_volatility, regr_slope(vol, n) as volatility_trend, avg(pvol) as pnl_volatility, regr_slope(pvol, n) as pnl_volatility_trend from x group by user_id""", (v.BETS,), "avg_volatility max_volatility normalized_volatility volatility_trend pnl_volatility pnl_volatility_trend")
def rolling_volatility(spark, sf):
    return ops.rolling_volatility(v.bets(spark, sf))


@query(f""", r as (select *, win_amount > bet_amount as won, row_number() {_W} n from bets), g as (select user_id, won, n - row_number() over (partition by user_id, won order by n) as island from r), c as (select user_id, won, island, count(*) k from g group by 1, 2, 3)
select user_id, coalesce(max(k) filter (where won), 0) as max_winning_streak, coalesce(max(k) filter (where not won), 0) as max_losing_streak from c group by user_id""", (v.BETS,))
def streaks(spark, sf):
    return ops.streaks(v.bets(spark, sf))


@query("""select user_id, sum(win_amount) - sum(bet_amount) as total_pnl, (sum(win_amount) - sum(bet_amount)) / (sum(bet_amount) + 1e-8) as roi, avg(case when win_amount > 0 then 1.0 else 0.0 end) as win_rate, case when sum(bet_amount) > 0 then sum(win_amount) / sum(bet_amount) end as rtp,
avg(win_amount) filter (where win_amount > 0) as avg_win_amount, max(win_amount) filter (where win_amount > 0) as max_win, avg(win_amount) filter (where win_amount > 0) / (avg(bet_amount) filter (where win_amount = 0) + 1e-8) as win_loss_ratio from bets group by user_id""", (v.BETS,), "total_pnl roi win_rate rtp avg_win_amount max_win win_loss_ratio")
def profitability(spark, sf):
    return ops.profitability(v.bets(spark, sf))


@query(""", q as (select user_id, quantile_cont(bet_amount, 0.33) a, quantile_cont(bet_amount, 0.67) b from bets group by user_id)
select bets.user_id, case when max(timestamp) > min(timestamp) then count(*) / ((epoch(max(timestamp)) - epoch(min(timestamp))) / 86400) end as transaction_frequency, count(*) as transactions_count, avg(bet_amount) as avg_transaction_size,
avg(case when bet_amount < a then 1.0 else 0.0 end) as small_bet_ratio, avg(case when bet_amount >= a and bet_amount < b then 1.0 else 0.0 end) as medium_bet_ratio, avg(case when bet_amount >= b then 1.0 else 0.0 end) as large_bet_ratio from bets join q on q.user_id = bets.user_id group by bets.user_id""", (v.BETS,), "transaction_frequency avg_transaction_size small_bet_ratio medium_bet_ratio large_bet_ratio")
def transaction_patterns(spark, sf):
    return ops.transaction_patterns(v.bets(spark, sf))


@query(f""", r as (select user_id, bet_amount, win_amount < bet_amount and lead(bet_amount) {_W} > bet_amount * 1.5 as chase, lead(bet_amount, 2) {_W} is not null as win, bet_amount / nullif(lag(bet_amount) {_W}, 0) - 1 as change from bets)
select user_id, case when count(*) >= 3 then count(*) filter (where chase and win) / count(*) filter (where win) end as loss_chase_frequency, case when count(*) > 5 then count(*) filter (where change < -0.5) / count(change) end as stop_loss_discipline, case when count(*) > 10 then quantile_cont(bet_amount, 0.95) / (avg(bet_amount) + 1e-8) end as var_95_ratio,
case when count(*) > 2 then stddev_samp(change) end as sizing_volatility, 1 / (1 + case when count(*) > 2 then stddev_samp(change) end) as sizing_discipline from r group by user_id""", (v.BETS,), "loss_chase_frequency stop_loss_discipline var_95_ratio sizing_volatility sizing_discipline")
def loss_control(spark, sf):
    return ops.loss_control(v.bets(spark, sf))


@query(f""", r as (select user_id, bet_amount b, row_number() {_W} - 1 as x, abs(bet_amount - lag(bet_amount) {_W}) d from bets)
select user_id, case when count(*) > 1 then stddev_samp(b) / (avg(b) + 1e-8) else 0 end as bet_volatility, case when count(*) >= 3 then regr_slope(b, x) / (avg(b) + 1e-8) else 0 end as bet_escalation, case when count(*) > 1 then quantile_cont(b, 0.95) / (median(b) + 1e-8) else 1 end as bet_p95_ratio, case when count(*) > 1 then max(b) / (avg(b) + 1e-8) else 1 end as bet_max_ratio,
case when count(*) > 1 then avg(d) / (avg(b) + 1e-8) else 0 end as impulsivity_score, case when count(*) > 1 then 1 / (1 + stddev_samp(b) / (avg(b) + 1e-8)) else 1 end as risk_consistency, regr_r2(b, x) as escalation_r2, count(*) as n_bets from r group by user_id""", (v.BETS,), "bet_volatility bet_escalation bet_p95_ratio bet_max_ratio impulsivity_score risk_consistency escalation_r2")
def risk_profile(spark, sf):
    return ops.risk_profile(v.bets(spark, sf))


@query(f""", r as (select user_id, bet_amount > win_amount as lost, lead(bet_amount) {_W} / nullif(bet_amount, 0) as q from bets)
select user_id, case when count(*) filter (where lost) > 1 and count(q) filter (where lost) > 0 then avg(case when q > 1.2 then 1.0 else 0.0 end) filter (where lost and q is not null) else 0 end as loss_chasing_tendency from r group by user_id""", (v.BETS,), "loss_chasing_tendency")
def loss_chasing(spark, sf):
    return ops.loss_chasing(v.bets(spark, sf))


@query(f""", r as (select *, (epoch(timestamp) - epoch(lag(timestamp) {_W})) / 3600 as gap from bets), d as (select user_id, 1 - stddev_samp(n) / sum(n) as weekday_consistency from (select user_id, isodow(timestamp), count(*) n from bets group by 1, 2) group by user_id)
select r.user_id, case when count(gap) > 1 then 1 / (1 + stddev_samp(gap) / (avg(gap) + 1e-8)) end as session_regularity, case when count(*) > 1 then 1 / (1 + stddev_samp(session_duration) / (avg(session_duration) + 1e-8)) end as duration_consistency, case when count(*) > 1 then 1 / (1 + stddev_samp(games_played) / (avg(games_played) + 1e-8)) end as games_consistency, any_value(weekday_consistency) as weekday_consistency
from r join d on d.user_id = r.user_id group by r.user_id""", (v.BETS,), "session_regularity duration_consistency games_consistency weekday_consistency")
def consistency(spark, sf):
    return ops.consistency(v.bets(spark, sf))


@query(f""", r as (select user_id, session_duration s, games_played g, avg(session_duration) {_R.format(2)} roll, row_number() {_W} n, count(*) over (partition by user_id) c from bets)
select user_id, case when sum(s) > 0 then sum(g) / (sum(s) / 60) end as games_per_minute, avg(g) / (avg(s) / 60 + 1e-8) as session_intensity, case when count(*) >= 3 then (avg(roll) filter (where n > floor(c / 2)) - avg(roll) filter (where n <= floor(c / 2))) / (avg(roll) filter (where n <= floor(c / 2)) + 1e-8) end as engagement_trend from r group by user_id""", (v.BETS,), "games_per_minute session_intensity engagement_trend")
def engagement(spark, sf):
    return ops.engagement(v.bets(spark, sf))


@query(f""", c as (select user_id, game_type, count(*) n from bets group by 1, 2), p as (select *, n / sum(n) over (partition by user_id) as p from c), s as (select user_id, case when game_type <> lag(game_type) {_W} then 1.0 when lag(game_type) {_W} is not null then 0.0 end as s from bets), t as (select user_id, coalesce(sum(s) / nullif(count(*) - 1, 0), 0) as game_switching_rate from s group by user_id)
select p.user_id, -sum(p * ln(p)) as game_entropy, count(*) as unique_game_types, sum(p * p) as game_concentration, any_value(game_switching_rate) as game_switching_rate from p join t on t.user_id = p.user_id group by p.user_id""", (v.BETS,), "game_entropy game_concentration game_switching_rate")
def game_diversity_index(spark, sf):
    return ops.game_diversity_index(v.bets(spark, sf))


@query(f""", r as (select user_id, stddev_samp(bet_amount) {_R.format(2)} / (avg(bet_amount) {_R.format(2)} + 1e-8) as q from bets)
select user_id, case when count(*) >= 5 then stddev_samp(q) end as strategy_adaptation from r group by user_id""", (v.BETS,), "strategy_adaptation")
def strategy_adaptation(spark, sf):
    return ops.strategy_adaptation(v.bets(spark, sf))


@query("select user_id, avg(case when hour(timestamp) between 18 and 23 then 1.0 else 0.0 end) as social_hours_ratio, avg(case when hour(timestamp) between 0 and 6 then 1.0 else 0.0 end) as solitary_hours_ratio, avg(promotion_used) as promotion_engagement from bets group by user_id", (v.BETS,), "social_hours_ratio solitary_hours_ratio promotion_engagement")
def social_behavior(spark, sf):
    return ops.social_behavior(v.bets(spark, sf))


_T = ["session_duration", "bet_amount", "games_played"]


@query(f", r as (select *, row_number() {_W} - 1 as x from bets) select user_id, " + ", ".join(f"case when count(*) >= 3 then regr_slope({c}, x) / (avg({c}) + 1e-8) end as {c}_trend, case when count(*) >= 3 then regr_r2({c}, x) end as {c}_trend_strength" for c in _T) + " from r group by user_id", (v.BETS,), " ".join(f"{c}_trend {c}_trend_strength" for c in _T))
def linear_trends(spark, sf):
    return ops.linear_trends(v.bets(spark, sf), _T)


@query(""", c as (select user_id, hour(timestamp) h, count(*) n from bets group by 1, 2), p as (select *, n / sum(n) over (partition by user_id) p, row_number() over (partition by user_id order by n desc, h) k from c), e as (select user_id, 1 / (1 - sum(p * ln(p))) as hour_concentration, max(h) filter (where k = 1) as peak_hour from p group by user_id)
select b.user_id, cast(any_value(peak_hour) as int) as peak_hour, avg(hour(timestamp)) as mean_hour, stddev_samp(hour(timestamp)) as hour_std, avg(case when hour(timestamp) between 0 and 6 then 1.0 else 0.0 end) as night_share, avg(case when hour(timestamp) between 19 and 23 then 1.0 else 0.0 end) as peak_share, avg(case when hour(timestamp) between 9 and 17 then 1.0 else 0.0 end) as business_share, count(*) as n_sessions, any_value(hour_concentration) as hour_concentration
from bets b join e on e.user_id = b.user_id group by b.user_id""", (v.BETS,), "mean_hour hour_std night_share peak_share business_share hour_concentration")
def circadian(spark, sf):
    return ops.circadian(v.bets(spark, sf))


@query(""", c as (select user_id, isodow(timestamp) - 1 d, count(*) n from bets group by 1, 2), p as (select *, n / sum(n) over (partition by user_id) p from c)
select user_id, sum(case when d >= 5 then p else 0 end) as weekend_share, -sum(p * ln(p)) / ln(7) as weekday_entropy, max(p) as max_weekday_share, (sum(n) filter (where d >= 5) / 2) / (sum(n) filter (where d < 5) / 5 + 1e-8) as weekend_weekday_ratio from p group by user_id""", (v.BETS,), "weekend_share weekday_entropy max_weekday_share weekend_weekday_ratio")
def weekly(spark, sf):
    return ops.weekly(v.bets(spark, sf))


@query(f""", r as (select user_id, (epoch(timestamp) - epoch(lag(timestamp) {_W})) / 3600 as gap from bets)
select user_id, case when count(gap) > 5 then avg(gap) end as avg_interval_hours, case when count(gap) > 5 then stddev_samp(gap) / (avg(gap) + 1e-8) end as interval_cv, case when count(gap) > 5 then count(*) filter (where gap < 2) / count(gap) end as burst_share, case when count(gap) > 5 then count(*) filter (where gap > 168) / count(gap) end as long_break_share from r group by user_id""", (v.BETS,), "avg_interval_hours interval_cv burst_share long_break_share")
def activity_cycles(spark, sf):
    return ops.activity_cycles(v.bets(spark, sf))


@query(f""", r as (select user_id, event_id, timestamp, (epoch(timestamp) - epoch(lag(timestamp) {_W})) / 3600 as gap from bets),
g as (select user_id, gap, row_number() {_W} - 1 as i, count(*) over (partition by user_id) as n from r where gap is not null),
f as (select user_id, n, k, sqrt(power(sum(gap * cos(2 * pi() * ((i * k) % n) / n)), 2) + power(sum(gap * sin(2 * pi() * ((i * k) % n) / n)), 2)) as m from g, (select unnest(range((select max(n) from g))) as k) where k < n group by 1, 2, 3),
c as (select *, round(m / avg(m) over (partition by user_id), 9) as s from f),
p as (select *, lag(s) over w as a, lead(s) over w as b from c where k >= 1 and k < n // 2 window w as (partition by user_id order by k)),
t as (select user_id, count(*) filter (where s > a and s > b and s >= 0.3) as peaks from p group by 1), u as (select distinct user_id, n from g)
select user_id, n as n_gaps, case when n >= 8 then coalesce(peaks, 0) / (n // 2 - 1) when n > 2 then 0.5::double end as cycle_regularity from u left join t using (user_id)""", (v.BETS,), "cycle_regularity")
def cycle_regularity(spark, sf):
    return ops.cycle_regularity(v.bets(spark, sf))


@query(""", d as (select user_id, cast(timestamp as date) x, min(hour(timestamp)) a, max(hour(timestamp)) b from bets group by 1, 2)
select user_id, avg(b - a) as avg_daily_span, avg(case when a <= 8 then 1.0 else 0.0 end) as early_share, avg(case when b >= 22 then 1.0 else 0.0 end) as late_share from d group by user_id""", (v.BETS,), "avg_daily_span early_share late_share")
def daily_span(spark, sf):
    return ops.daily_span(v.bets(spark, sf))


@query(""", o as (select o_custkey as user_id, o_orderdate as timestamp from orders), m as (select user_id, month(timestamp) x, count(*) n from o group by 1, 2), mp as (select *, n / sum(n) over (partition by user_id) p from m), q as (select user_id, quarter(timestamp) x, count(*) n from o group by 1, 2), qp as (select *, n / sum(n) over (partition by user_id) p from q), qs as (select user_id, max(p) as max_quarter_share from qp group by user_id)
select mp.user_id, 1 + sum(p * ln(p)) / ln(12) as monthly_seasonality, any_value(max_quarter_share) as max_quarter_share from mp join qs on qs.user_id = mp.user_id group by mp.user_id""", (v.BETS,), "monthly_seasonality max_quarter_share")
def seasonality(spark, sf):
    orders = v.table(spark, sf, "orders").selectExpr("o_custkey as user_id", "cast(o_orderdate as timestamp) as timestamp")
    return ops.seasonality(orders)


@query(""", c as (select user_id, hour(timestamp) h, count(*) n from bets group by 1, 2), f as (select user_id, k, sqrt(power(sum(n * cos(2 * pi() * k * h / 24)), 2) + power(sum(n * sin(2 * pi() * k * h / 24)), 2)) m, sum(n) t from c, range(1, 12) r(k) group by 1, 2),
g as (select *, lag(m) over (partition by user_id order by k) a, lead(m) over (partition by user_id order by k) b from f)
select user_id, count(*) filter (where m > a and m > b) / 11 as rhythm_peaks, max(m) / any_value(t) as rhythm_max, avg(m) / any_value(t) as rhythm_mean from g group by user_id""", (v.BETS,), "rhythm_peaks rhythm_max rhythm_mean")
def rhythm(spark, sf):
    return ops.rhythm(v.bets(spark, sf), places=None)


@query(""", c as (select user_id, channel, count(*) n from inter group by 1, 2), p as (select *, n / sum(n) over (partition by user_id) p, row_number() over (partition by user_id order by n desc, channel) k from c)
select user_id, max(channel) filter (where k = 1) as preferred_channel, max(p) as preferred_share, -sum(p * ln(p)) / ln(6) as channel_entropy, """ + ", ".join(f"coalesce(max(p) filter (where channel = '{c}'), 0) as share_{c}" for c in v.CHANNELS) + " from p group by user_id", (v.INTER,), "preferred_share channel_entropy " + " ".join(f"share_{c}" for c in v.CHANNELS))
def channel_preference(spark, sf):
    return ops.channel_preference(v.interactions(spark, sf), v.CHANNELS)


@query("select user_id, avg(responded) as response_rate, " + ", ".join(f"avg(responded) filter (where campaign_type = '{t}') as response_{t}" for t in v.CAMPAIGN_TYPES) + ", avg(delay_hours) filter (where responded = 1) as avg_response_delay, avg(case when delay_hours <= 24 then 1.0 else 0.0 end) filter (where responded = 1) as quick_response_share from inter group by user_id", (v.INTER,), "response_rate avg_response_delay quick_response_share " + " ".join(f"response_{t}" for t in v.CAMPAIGN_TYPES))
def campaign_response(spark, sf):
    return ops.campaign_response(v.interactions(spark, sf), v.CAMPAIGN_TYPES)


@query(""", c as (select user_id, interaction_type, count(*) n from inter group by 1, 2), p as (select user_id, -sum(q * ln(q)) as e from (select user_id, n / sum(n) over (partition by user_id) q from c) group by user_id)
select i.user_id, count(*) as total_interactions, count(*) / ((epoch(max(timestamp)) - epoch(min(timestamp))) / 86400 + 1) as interactions_per_day, avg(case when interaction_type = 'proactive' then 1.0 else 0.0 end) as proactive_share, avg(case when interaction_type = 'reactive' then 1.0 else 0.0 end) as reactive_share, count(*) filter (where interaction_type like '%support%') as support_tickets, avg(case when content_type = 'promo' then 1.0 else 0.0 end) as promo_share, any_value(e) as interaction_entropy
from inter i join p on p.user_id = i.user_id group by i.user_id""", (v.INTER,), "interactions_per_day proactive_share reactive_share promo_share interaction_entropy")
def interaction_level(spark, sf):
    return ops.interaction_level(v.interactions(spark, sf))


@query(""", h as (select user_id, h from (select user_id, hour(timestamp) h, row_number() over (partition by user_id order by count(*) desc, hour(timestamp)) k from inter group by 1, 2) where k = 1)
select i.user_id, cast(any_value(h.h) as int) as preferred_contact_hour, avg(case when hour(timestamp) < 6 then 1.0 else 0.0 end) as night_contacts, avg(case when hour(timestamp) between 6 and 11 then 1.0 else 0.0 end) as morning_contacts, avg(case when hour(timestamp) between 12 and 17 then 1.0 else 0.0 end) as afternoon_contacts, avg(case when hour(timestamp) >= 18 then 1.0 else 0.0 end) as evening_contacts, avg(case when isodow(timestamp) >= 6 then 1.0 else 0.0 end) as weekend_contacts
from inter i join h on h.user_id = i.user_id group by i.user_id""", (v.INTER,), "night_contacts morning_contacts afternoon_contacts evening_contacts weekend_contacts")
def contact_timing(spark, sf):
    return ops.contact_timing(v.interactions(spark, sf))


@query(""", m as (select user_id, content_type, round(avg(engagement_score), 9) m from inter group by 1, 2), k as (select *, row_number() over (partition by user_id order by m desc, content_type) n from m)
select user_id, content_type as best_content, m as best_engagement from k where n = 1""", (v.INTER,), "best_engagement")
def content_preference(spark, sf):
    return ops.content_preference(v.interactions(spark, sf))


_N = ["bet_amount", "win_amount", "session_duration", "games_played"]


@query(", l as (" + " union all ".join(f"select '{c}' as feature, {c}::double as x from bets" for c in _N) + ") select feature, count(x) as n, count(*) - count(x) as nulls, avg(x) as mean, stddev_samp(x) as std, min(x) as min, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, max(x) as max from l group by feature", (v.BETS,), "mean std min p25 p50 p75 max")
def feature_documentation(spark, sf):
    return ops.feature_documentation(v.bets(spark, sf), _N)


@query(", c as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as correlation from bets" for i, a in enumerate(_N) for b in _N[i + 1:]) + ") select *, abs(correlation) > 0.8 as redundant from c", (v.BETS,), "correlation")
def feature_redundancy(spark, sf):
    return ops.feature_redundancy(v.bets(spark, sf), _N)


@query(" select * from (select feature, var_samp(x) as variance, avg(case when x is null then 1.0 else 0.0 end) as null_share, coalesce(var_samp(x), 0) < 0.01 or avg(case when x is null then 1.0 else 0.0 end) > 0.5 as drop from (" + " union all ".join(f"select '{a}' as feature, {a}::double as x from bets" for a in [*_N, "deposit_amount"]) + ") group by feature)", (v.BETS,), "variance null_share")
def feature_quality(spark, sf):
    return ops.feature_quality(v.bets(spark, sf), [*_N, "deposit_amount"])


@query(", c as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as correlation from bets" for i, a in enumerate(_N) for b in _N[i + 1:]) + ") select *, abs(correlation) > 0.8 as redundant from c order by round(abs(correlation), 9) desc, a, b limit 3", (v.BETS,), "correlation")
def top_correlations(spark, sf):
    return ops.top_correlations(ops.feature_redundancy(v.bets(spark, sf), _N), 3)


@query(""", b as (select user_id, count(*) filter (where interaction_type like '%support%') as support_tickets, avg(case when interaction_type like '%support%' then 1.0 else 0.0 end) as support_rate, avg(engagement_score) filter (where interaction_type like '%support%') as satisfaction from inter group by 1),
i as (select user_id, content_type, count(*) n from inter where interaction_type like '%support%' group by 1, 2), p as (select *, n / sum(n) over (partition by user_id) q, row_number() over (partition by user_id order by n desc, content_type) k from i), t as (select user_id, max(content_type) filter (where k = 1) as top_issue, -sum(q * ln(q)) as issue_entropy from p group by 1)
select b.*, top_issue, issue_entropy from b left join t on t.user_id = b.user_id""", (v.INTER,), "support_rate satisfaction issue_entropy")
def support_profile(spark, sf):
    return ops.support_profile(v.interactions(spark, sf))
