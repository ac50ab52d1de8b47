"""Financial, behavioural, temporal and communication profiles per user. Row order within a user is (timestamp,
event_id); sequence columns are one window over the user, after which one groupBy on the same key needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles
from ..functions.spectrum import spectral_peaks
from ..functions.stats import coefficient_of_variation, entropy, ratio, share, shares

# Tiers by mean bet.
WHALE, HIGH_ROLLER = 10_000.0, 1000.0


def _user():
    return Window.partitionBy("user_id")


def _order():
    return _user().orderBy("timestamp", "event_id")


def _bets(df: DataFrame) -> DataFrame:
    """Rows with a bet; a missing win is 0."""
    return df.where(F.col("bet_amount").isNotNull()).withColumn("win_amount", F.coalesce("win_amount", F.lit(0.0)))


# --- financial ---------------------------------------------------------------------------------------------


def spending(df: DataFrame) -> DataFrame:
    b, mean = F.col("bet_amount"), F.avg("bet_amount")
    q = F.percentile("bet_amount", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95)]))
    out = _bets(df).groupBy("user_id").agg(
        F.sum(b).alias("total_wagered"), mean.alias("avg_bet"), F.max(b).alias("max_bet"), F.min(b).alias("min_bet"), F.stddev_samp(b).alias("bet_std"),
        coefficient_of_variation(b).alias("bet_cv"), F.skewness(b).alias("bet_skewness"), F.kurtosis(b).alias("bet_kurtosis"), q.alias("_q"),
        F.when(mean >= WHALE, 3).when(mean >= HIGH_ROLLER, 2).otherwise(1).alias("user_tier"))
    for i, name in enumerate(("bet_p25", "median_bet", "bet_p75", "bet_p90", "bet_p95")):
        out = out.withColumn(name, F.col("_q")[i])
    return out.withColumn("max_bet_ratio", ratio(F.col("max_bet"), F.col("avg_bet"))).withColumn("p95_avg_ratio", ratio(F.col("bet_p95"), F.col("avg_bet"))).drop("_q")


def spending_concentration(df: DataFrame, bins: int = 5) -> DataFrame:
    """Herfindahl index over equal-width bins of each user's bets; bins are closed on the right. Equal bets: 1."""
    rows = _bets(df).select("user_id", "bet_amount", F.min("bet_amount").over(_user()).alias("lo"), F.max("bet_amount").over(_user()).alias("hi"))
    place = F.ceil((F.col("bet_amount") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    rows = rows.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(1), F.least(F.lit(bins), place))).otherwise(1).cast("int"))
    return shares(rows, "user_id", "bin").groupBy("user_id").agg(F.sum(F.col("p") * F.col("p")).alias("spending_concentration"))


def bankroll(df: DataFrame) -> DataFrame:
    d = F.when(F.col("deposit_amount") > 0, F.col("deposit_amount"))
    out = df.groupBy("user_id").agg(
        F.sum(d).alias("total_deposits"), F.avg(d).alias("avg_deposit"), F.count(d).alias("deposit_frequency"), F.max(d).alias("max_deposit"),
        coefficient_of_variation(d).alias("deposit_cv"), F.sum("bet_amount").alias("_bets"), F.avg("bet_amount").alias("_bet"), share(F.col("win_amount") > 0).alias("_win"))
    sizing = ratio(F.col("_bet"), F.col("avg_deposit"))
    kelly = F.when((F.col("_win") > 0) & (F.col("_win") < 1), F.abs(sizing - F.greatest(F.lit(0.0), 2 * F.col("_win") - 1)))
    return out.select("user_id", "total_deposits", "avg_deposit", "deposit_frequency", "max_deposit", "deposit_cv",
                      ratio(F.col("_bets"), F.col("total_deposits")).alias("bet_deposit_ratio"), sizing.alias("bet_sizing_ratio"), kelly.alias("kelly_deviation"))


def rolling_volatility(df: DataFrame, window: int = 10) -> DataFrame:
    """Sample spread over the last ``window`` bets, from the first full window on: mean, maximum, normalised mean and
    linear trend over its order; the same for net results. Null below ``window`` bets."""
    rows = _bets(df).withColumn("n", F.row_number().over(_order())).withColumn("pnl", F.col("win_amount") - F.col("bet_amount"))
    frame = _order().rowsBetween(1 - window, 0)
    full = F.col("n") >= window
    rows = rows.select("user_id", "n", "bet_amount", F.when(full, F.stddev_samp("bet_amount").over(frame)).alias("v"), F.when(full, F.stddev_samp("pnl").over(frame)).alias("pv"))
    place = F.when(F.col("v").isNotNull(), F.col("n").cast("double"))
    slope = lambda c: F.regr_slope(F.col(c), place)
    return rows.groupBy("user_id").agg(
        F.avg("v").alias("avg_volatility"), F.max("v").alias("max_volatility"), ratio(F.avg("v"), F.avg("bet_amount")).alias("normalized_volatility"), slope("v").alias("volatility_trend"),
        F.avg("pv").alias("pnl_volatility"), slope("pv").alias("pnl_volatility_trend"))


def streaks(df: DataFrame) -> DataFrame:
    """Longest runs of net wins and of other results."""
    rows = _bets(df).withColumn("won", F.col("win_amount") > F.col("bet_amount"))
    rows = rows.withColumn("change", F.coalesce((F.col("won") != F.lag("won").over(_order())).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("change").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("user_id", "island", "won").agg(F.count("*").alias("n"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    return runs.groupBy("user_id").agg(longest(F.col("won")).alias("max_winning_streak"), longest(~F.col("won")).alias("max_losing_streak"))


def profitability(df: DataFrame) -> DataFrame:
    w, b = F.col("win_amount"), F.col("bet_amount")
    won, total = F.when(w > 0, w), F.sum(b)
    return _bets(df).groupBy("user_id").agg(
        (F.sum(w) - total).alias("total_pnl"), ratio(F.sum(w) - total, total).alias("roi"), share(w > 0).alias("win_rate"), F.when(total > 0, F.sum(w) / total).alias("rtp"),
        F.avg(won).alias("avg_win_amount"), F.max(won).alias("max_win"), ratio(F.avg(won), F.avg(F.when(w == 0, b))).alias("win_loss_ratio"))


def transaction_patterns(df: DataFrame) -> DataFrame:
    """Rows per day of the user's span, and shares of bets below the own 33 % quantile, between and from 67 % on."""
    rows = _bets(df)
    cuts = rows.groupBy("user_id").agg(F.percentile("bet_amount", F.array(F.lit(0.33), F.lit(0.67))).alias("c"))
    span = (F.max("timestamp").cast("double") - F.min("timestamp").cast("double")) / 86400
    b = F.col("bet_amount")
    return rows.join(cuts, "user_id").groupBy("user_id").agg(
        F.when(span > 0, F.count("*") / span).alias("transaction_frequency"), F.count("*").alias("transactions_count"), F.avg(b).alias("avg_transaction_size"),
        share(b < F.col("c")[0]).alias("small_bet_ratio"), share((b >= F.col("c")[0]) & (b < F.col("c")[1])).alias("medium_bet_ratio"), share(b >= F.col("c")[1]).alias("large_bet_ratio"))


def loss_control(df: DataFrame) -> DataFrame:
    """Share of three-bet windows whose first bet lost and whose second is 1.5 times as large; share of bets that fall
    by more than half (over 5 bets); 95 % quantile over mean (over 10 bets); sizing volatility and discipline (over 2)."""
    b, w = F.col("bet_amount"), F.col("win_amount")
    rows = _bets(df).select("user_id", b, ((w < b) & (F.lead(b).over(_order()) > b * 1.5)).alias("chase"), F.lead(b, 2).over(_order()).isNotNull().alias("window"), (F.when(F.lag(b).over(_order()) != 0, b / F.lag(b).over(_order())) - 1).alias("change"))
    n = F.count("*")
    out = rows.groupBy("user_id").agg(
        F.when(n >= 3, F.count_if(F.col("chase") & F.col("window")) / F.count_if("window")).alias("loss_chase_frequency"),
        F.when(n > 5, F.count_if(F.col("change") < -0.5) / F.count("change")).alias("stop_loss_discipline"),
        F.when(n > 10, ratio(F.percentile(b, F.lit(0.95)), F.avg(b))).alias("var_95_ratio"), F.when(n > 2, F.stddev_samp("change")).alias("sizing_volatility"))
    return out.withColumn("sizing_discipline", 1 / (1 + F.col("sizing_volatility")))


def financial_insights(features: DataFrame) -> DataFrame:
    """One row over users with user_tier, roi and normalized_volatility: shares of tiers, of profitable users, and of low and
    high volatility. The median is approximate (to 1 in 100,000 ranks), so that no task holds all users."""
    r, v = F.col("roi"), F.col("normalized_volatility")
    of = lambda c: F.avg(c.cast("double"))
    return features.agg(
        share(F.col("user_tier") == 3).alias("whale_share"), share(F.col("user_tier") == 2).alias("high_roller_share"), share(F.col("user_tier") == 1).alias("regular_share"),
        of(r > 0).alias("profitable_share"), F.avg(r).alias("mean_roi"), F.percentile_approx(r, F.lit(0.5), F.lit(100_000)).alias("median_roi"), of(r > 0.1).alias("high_profit_share"),
        of(v < 0.5).alias("low_volatility_share"), of(v > 2.0).alias("high_volatility_share"), F.avg(v).alias("mean_volatility"))


# --- behavioural -------------------------------------------------------------------------------------------


def risk_profile(df: DataFrame) -> DataFrame:
    """Volatility, escalation (slope over order per mean), tail ratios, impulsivity and consistency; one bet gives the
    defaults 0 or 1."""
    b = F.col("bet_amount")
    rows = _bets(df).select("user_id", b, (F.row_number().over(_order()) - 1).cast("double").alias("x"), F.abs(b - F.lag(b).over(_order())).alias("d"))
    n, cv = F.count("*"), coefficient_of_variation(b)
    many = lambda c, other: F.when(n > 1, c).otherwise(F.lit(other))
    return rows.groupBy("user_id").agg(
        many(cv, 0.0).alias("bet_volatility"), F.when(n >= 3, ratio(F.regr_slope(b, F.col("x")), F.avg(b))).otherwise(0.0).alias("bet_escalation"),
        many(ratio(F.percentile(b, F.lit(0.95)), F.median(b)), 1.0).alias("bet_p95_ratio"), many(ratio(F.max(b), F.avg(b)), 1.0).alias("bet_max_ratio"),
        many(ratio(F.avg("d"), F.avg(b)), 0.0).alias("impulsivity_score"), many(1 / (1 + cv), 1.0).alias("risk_consistency"),
        F.regr_r2(b, F.col("x")).alias("escalation_r2"), n.alias("n_bets"))


def loss_chasing(df: DataFrame, factor: float = 1.2) -> DataFrame:
    """Of losing bets with a next one, the share whose next bet is more than 1.2 times as large; 0 below two losses."""
    b = F.col("bet_amount")
    rows = _bets(df).select("user_id", (b > F.col("win_amount")).alias("lost"), (F.lead(b).over(_order()) / F.when(b != 0, b)).alias("r"))
    lost = F.when(F.col("lost"), F.col("r"))
    return rows.groupBy("user_id").agg(F.when((F.count_if("lost") > 1) & (F.count(lost) > 0), F.avg((lost > factor).cast("double"))).otherwise(0.0).alias("loss_chasing_tendency"))


def consistency(df: DataFrame) -> DataFrame:
    """Session regularity 1 / (1 + cv of gaps in hours), weekday, duration and games consistency."""
    rows = df.withColumn("gap", (F.col("timestamp").cast("double") - F.lag(F.col("timestamp").cast("double")).over(_order())) / 3600)
    base = rows.groupBy("user_id").agg(
        F.when(F.count("gap") > 1, 1 / (1 + coefficient_of_variation("gap"))).alias("session_regularity"),
        F.when(F.count("session_duration") > 1, 1 / (1 + coefficient_of_variation("session_duration"))).alias("duration_consistency"),
        F.when(F.count("games_played") > 1, 1 / (1 + coefficient_of_variation("games_played"))).alias("games_consistency"))
    days = df.groupBy("user_id", F.weekday("timestamp").alias("d")).count().groupBy("user_id").agg((1 - F.stddev_samp("count") / F.sum("count")).alias("weekday_consistency"))
    return base.join(days, "user_id")


def engagement(df: DataFrame) -> DataFrame:
    """Games per minute, intensity, and the change of the rolling mean duration (3 rows) from the first half of a
    user's rows to the second (3 rows at least)."""
    rows = df.withColumn("roll", F.avg("session_duration").over(_order().rowsBetween(-2, 0))).withColumn("n", F.row_number().over(_order())).withColumn("all", F.count("*").over(_user()))
    early = F.col("n") <= F.floor(F.col("all") / 2)
    first, second = F.avg(F.when(early, F.col("roll"))), F.avg(F.when(~early, F.col("roll")))
    return rows.groupBy("user_id").agg(
        F.when(F.sum("session_duration") > 0, F.sum("games_played") / (F.sum("session_duration") / 60)).alias("games_per_minute"),
        ratio(F.avg("games_played"), F.avg("session_duration") / 60).alias("session_intensity"), F.when(F.count("*") >= 3, ratio(second - first, first)).alias("engagement_trend"))


def game_diversity_index(df: DataFrame) -> DataFrame:
    """Entropy, distinct types and Herfindahl index of game types, and how often the type changes from row to row."""
    types = shares(df, "user_id", "game_type").groupBy("user_id").agg(entropy("p").alias("game_entropy"), F.count("*").alias("unique_game_types"), F.sum(F.col("p") * F.col("p")).alias("game_concentration"))
    rows = df.select("user_id", (F.col("game_type") != F.lag("game_type").over(_order())).cast("double").alias("s"))
    return types.join(rows.groupBy("user_id").agg(F.coalesce(F.sum("s") / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("game_switching_rate")), "user_id")


def strategy_adaptation(df: DataFrame) -> DataFrame:
    """Sample spread of the rolling cv of bets (3 rows, from the second on); null below 5 bets."""
    frame = _order().rowsBetween(-2, 0)
    rows = _bets(df).select("user_id", ratio(F.stddev_samp("bet_amount").over(frame), F.avg("bet_amount").over(frame)).alias("r"))
    return rows.groupBy("user_id").agg(F.when(F.count("*") >= 5, F.stddev_samp("r")).alias("strategy_adaptation"))


def social_behavior(df: DataFrame) -> DataFrame:
    h = F.hour("timestamp")
    return df.groupBy("user_id").agg(share(h.between(18, 23)).alias("social_hours_ratio"), share(h.between(0, 6)).alias("solitary_hours_ratio"), F.avg(F.coalesce("promotion_used", F.lit(0)).cast("double")).alias("promotion_engagement"))


def linear_trends(df: DataFrame, columns: list[str]) -> DataFrame:
    """Slope over row order per mean and r² of each column; null below 3 rows."""
    rows = df.withColumn("_x", (F.row_number().over(_order()) - 1).cast("double"))
    x, many = F.col("_x"), F.count("*") >= 3
    return rows.groupBy("user_id").agg(*[e for c in columns for e in (
        F.when(many, ratio(F.regr_slope(F.col(c).cast("double"), x), F.avg(c))).alias(f"{c}_trend"), F.when(many, F.regr_r2(F.col(c).cast("double"), x)).alias(f"{c}_trend_strength"))])


# --- temporal ----------------------------------------------------------------------------------------------


def circadian(df: DataFrame) -> DataFrame:
    """Modal and mean hour, spread, concentration 1 / (1 + entropy of hours), shares of night, peak and business hours."""
    rows = df.withColumn("hour", F.hour("timestamp"))
    base = rows.groupBy("user_id").agg(
        F.mode("hour", True).alias("peak_hour"), F.avg("hour").alias("mean_hour"), F.stddev_samp("hour").alias("hour_std"), share(F.col("hour").between(0, 6)).alias("night_share"),
        share(F.col("hour").between(19, 23)).alias("peak_share"), share(F.col("hour").between(9, 17)).alias("business_share"), F.count("*").alias("n_sessions"))
    return base.join(shares(rows, "user_id", "hour").groupBy("user_id").agg((1 / (1 + entropy("p"))).alias("hour_concentration")), "user_id")


def weekly(df: DataFrame) -> DataFrame:
    """Weekend share, entropy of weekdays over ln 7, largest weekday share, weekend to weekday rate per day."""
    rows = df.withColumn("d", F.weekday("timestamp"))
    days = shares(rows, "user_id", "d").groupBy("user_id").agg(
        F.sum(F.when(F.col("d") >= 5, F.col("p")).otherwise(0.0)).alias("weekend_share"), (entropy("p") / F.log(F.lit(7.0))).alias("weekday_entropy"), F.max("p").alias("max_weekday_share"),
        ratio(F.sum(F.when(F.col("d") >= 5, F.col("n"))) / 2, F.sum(F.when(F.col("d") < 5, F.col("n"))) / 5).alias("weekend_weekday_ratio"))
    return days


def activity_cycles(df: DataFrame) -> DataFrame:
    """Gaps between sessions in hours: mean, cv, shares under 2 and over 168 hours; null at 5 gaps or fewer."""
    rows = df.select("user_id", ((F.col("timestamp").cast("double") - F.lag(F.col("timestamp").cast("double")).over(_order())) / 3600).alias("gap"))
    many, known = F.count("gap") > 5, F.col("gap").isNotNull()
    part = lambda c: F.count_if(known & c) / F.count("gap")
    return rows.groupBy("user_id").agg(
        F.when(many, F.avg("gap")).alias("avg_interval_hours"), F.when(many, coefficient_of_variation("gap")).alias("interval_cv"),
        F.when(many, part(F.col("gap") < 2)).alias("burst_share"), F.when(many, part(F.col("gap") > 168)).alias("long_break_share"))


def cycle_regularity(df: DataFrame, **options) -> DataFrame:
    """(user_id, n_gaps, cycle_regularity): peaks of the spectrum of a user's gaps between sessions, of at least 0.3 of its mean, over
    the places that a peak can have; 0.5 for fewer than 8 gaps, null for fewer than 3. A user of any length is many tasks' work."""
    gaps = df.select("user_id", "timestamp", "event_id", ((F.col("timestamp").cast("double") - F.lag(F.col("timestamp").cast("double")).over(_order())) / 3600).alias("gap"))
    found = spectral_peaks(gaps, "user_id", "gap", "timestamp", "event_id", **options)
    regular = F.when(F.col("n") >= 8, F.col("peaks") / (F.floor(F.col("n") / 2) - 1)).when(F.col("n") > 2, 0.5)
    return found.select("user_id", F.col("n").alias("n_gaps"), regular.alias("cycle_regularity"))


def daily_span(df: DataFrame) -> DataFrame:
    """Means over a user's days of the hours between first and last row, and shares of days that begin by 8 or end from 22."""
    days = df.groupBy("user_id", F.to_date("timestamp").alias("day")).agg(F.min(F.hour("timestamp")).alias("a"), F.max(F.hour("timestamp")).alias("b"))
    return days.groupBy("user_id").agg(F.avg((F.col("b") - F.col("a")).cast("double")).alias("avg_daily_span"), share(F.col("a") <= 8).alias("early_share"), share(F.col("b") >= 22).alias("late_share"))


def seasonality(df: DataFrame) -> DataFrame:
    """1 - entropy of months over ln 12, and the largest share of a quarter."""
    rows = df.withColumn("m", F.month("timestamp")).withColumn("q", F.quarter("timestamp"))
    months = shares(rows, "user_id", "m").groupBy("user_id").agg((1 - entropy("p") / F.log(F.lit(12.0))).alias("monthly_seasonality"))
    return months.join(shares(rows, "user_id", "q").groupBy("user_id").agg(F.max("p").alias("max_quarter_share")), "user_id")


def rhythm(df: DataFrame, places: int | None = 9) -> DataFrame:
    """Discrete Fourier transform of each user's 24 hourly counts, added in order of hours: peaks of the first 11 magnitudes over
    11 and the largest and mean magnitude over rows. Neighbours that are equal to so many places are one place of a peak, whose
    last bits decide nothing; without ``places`` magnitudes are compared as the sums come, as SQL does."""
    rows = df.groupBy("user_id", F.hour("timestamp").alias("h")).count()
    per = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("h", "count"))).alias("c"), F.sum("count").alias("n"))
    part = lambda f: F.expr(f"transform(sequence(1, 11), k -> aggregate(c, 0D, (a, x) -> a + x.count * {f}(2 * pi() * k * x.h / 24)))")
    per = per.withColumn("re", part("cos")).withColumn("im", part("sin")).withColumn("m", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)))
    per = per.withColumn("d", F.col("m") if places is None else F.expr(f"transform(m, x -> round(x, {places}))"))
    if places is not None:
        per = per.withColumn("d", F.expr("filter(d, (x, i) -> i = 0 or x <> get(d, i - 1))"))
    peaks = F.expr("size(filter(d, (x, i) -> x > get(d, i - 1) and x > get(d, i + 1)))")
    mean = F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / 11
    return per.select("user_id", (peaks / 11.0).alias("rhythm_peaks"), (F.array_max("m") / F.col("n")).alias("rhythm_max"), (mean / F.col("n")).alias("rhythm_mean"))


# --- communication -----------------------------------------------------------------------------------------


def channel_preference(df: DataFrame, channels: list[str]) -> DataFrame:
    """Preferred channel (smallest name among ties), its share, entropy over ln 6, and the share of each channel."""
    p = shares(df, "user_id", "channel")
    best = F.min(F.struct((-F.col("n")).alias("n"), "channel"))["channel"]
    return p.groupBy("user_id").agg(
        best.alias("preferred_channel"), F.max("p").alias("preferred_share"), (entropy("p") / F.log(F.lit(float(len(channels))))).alias("channel_entropy"),
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("p"))), F.lit(0.0)).alias(f"share_{c}") for c in channels])


def campaign_response(df: DataFrame, types: list[str]) -> DataFrame:
    """Response rate overall and per campaign type, mean delay of responses and the share within 24 hours."""
    yes = F.col("responded") == 1
    delay = F.when(yes, F.col("delay_hours"))
    return df.groupBy("user_id").agg(
        F.avg(F.col("responded").cast("double")).alias("response_rate"), *[F.avg(F.when(F.col("campaign_type") == t, F.col("responded").cast("double"))).alias(f"response_{t}") for t in types],
        F.avg(delay).alias("avg_response_delay"), F.avg((delay <= 24).cast("double")).alias("quick_response_share"))


def interaction_level(df: DataFrame) -> DataFrame:
    days = (F.max("timestamp").cast("double") - F.min("timestamp").cast("double")) / 86400
    base = df.groupBy("user_id").agg(
        F.count("*").alias("total_interactions"), (F.count("*") / (days + 1)).alias("interactions_per_day"), share(F.col("interaction_type") == "proactive").alias("proactive_share"),
        share(F.col("interaction_type") == "reactive").alias("reactive_share"), F.count_if(F.contains(F.col("interaction_type"), F.lit("support"))).alias("support_tickets"), share(F.col("content_type") == "promo").alias("promo_share"))
    return base.join(shares(df, "user_id", "interaction_type").groupBy("user_id").agg(entropy("p").alias("interaction_entropy")), "user_id")


def contact_timing(df: DataFrame) -> DataFrame:
    h = F.hour("timestamp")
    return df.groupBy("user_id").agg(
        F.mode(h, True).alias("preferred_contact_hour"), share(h < 6).alias("night_contacts"), share(h.between(6, 11)).alias("morning_contacts"), share(h.between(12, 17)).alias("afternoon_contacts"),
        share(h >= 18).alias("evening_contacts"), share(F.weekday("timestamp") >= 5).alias("weekend_contacts"))


def content_preference(df: DataFrame) -> DataFrame:
    """Content type of the highest mean engagement (smallest name among ties) and that mean."""
    means = df.groupBy("user_id", "content_type").agg(F.round(F.avg("engagement_score"), 9).alias("m"))
    w = Window.partitionBy("user_id").orderBy(F.desc("m"), "content_type")
    return means.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", F.col("content_type").alias("best_content"), F.col("m").alias("best_engagement"))


def feature_documentation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, nulls, mean, std, min, p25, p50, p75, max) of each numeric column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    exact = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    of = F.create_map(*[x for c, v in exact.items() for x in (F.lit(c), F.array(*[F.lit(y).cast("double") for y in v]))])
    q = F.first(of[F.col("feature")])
    return long.groupBy("feature").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max("v").alias("max"))


def feature_quality(df: DataFrame, columns: list[str], least_variance: float = 0.01, most_null: float = 0.5) -> DataFrame:
    """(feature, variance, null_share, drop): columns of little variance or of many nulls are to be dropped."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    one = long.groupBy("feature").agg(F.var_samp("v").alias("variance"), F.avg(F.col("v").isNull().cast("double")).alias("null_share"))
    return one.withColumn("drop", (F.coalesce("variance", F.lit(0.0)) < least_variance) | (F.col("null_share") > most_null))


def top_correlations(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs of ``feature_redundancy`` of largest absolute correlation, ties by name."""
    return pairs.where("correlation is not null").orderBy(F.desc(F.round(F.abs("correlation"), 9)), "a", "b").limit(k)


def support_profile(df: DataFrame) -> DataFrame:
    """Per user support tickets, their share, the commonest content of tickets (smallest name of equals), the entropy of
    their contents and their mean engagement; users without tickets have nulls there."""
    ticket = F.contains(F.col("interaction_type"), F.lit("support"))
    base = df.groupBy("user_id").agg(F.count_if(ticket).alias("support_tickets"), share(ticket).alias("support_rate"), F.avg(F.when(ticket, F.col("engagement_score"))).alias("satisfaction"))
    issues = shares(df.where(ticket), "user_id", "content_type").groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "content_type"))["content_type"].alias("top_issue"), entropy("p").alias("issue_entropy"))
    return base.join(issues, "user_id", "left")


def feature_redundancy(df: DataFrame, columns: list[str], limit: float = 0.8) -> DataFrame:
    """(a, b, correlation, redundant) of all pairs of the named columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).withColumn("redundant", F.abs("correlation") > limit)


