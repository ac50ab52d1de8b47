"""The domain model over the stored tables: transactions, bets, interactions, users, campaigns, ratings, vectors.

Each view is a DataFrame function here and a common table expression for DuckDB beside it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = dt.datetime(2024, 1, 31)
ORDERS_AS_OF = dt.datetime(2001, 8, 2)

# Categories of the domain.
GAME_TYPES = ["crash", "cassino", "esportes", "poker", "slots", "roleta", "blackjack"]
CHANNELS = ["email", "sms", "push", "whatsapp", "telegram", "phone"]
DEVICES = ["mobile", "desktop", "tablet"]
CAMPAIGN_TYPES = ["promotional", "retention", "informational"]
CONTENT_TYPES = ["promo", "news", "tips", "support"]
KINDS = {"signup": "bonus", "view": "bet", "click": "win", "purchase": "deposit", "error": "withdrawal"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(k, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("transaction_id"), "user_id", F.col("value").alias("amount"), F.col("ts").alias("created_at"),
        kind.alias("transaction_type"), F.when(k % 10 == 0, "failed").otherwise("completed").alias("status"),
        _pick(k, GAME_TYPES).alias("game_type"), _pick(k, CHANNELS).alias("channel"), _pick(k, DEVICES).alias("device"))


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).select(
        "event_id", "user_id", F.col("ts").alias("timestamp"), F.col("value").alias("bet_amount"),
        (F.col("value") * (k % 3) * 0.7).alias("win_amount"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("deposit_amount"),
        (F.lit(60.0) * (1 + k % 45)).alias("session_duration"), (1 + k % 9).cast("long").alias("games_played"),
        _pick(k, GAME_TYPES).alias("game_type"), (k % 4 == 0).cast("int").alias("promotion_used"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).select(
        "event_id", "user_id", F.col("ts").alias("timestamp"), _pick(k, CHANNELS).alias("channel"), (k % 5 == 0).cast("int").alias("responded"),
        _pick(k, CAMPAIGN_TYPES).alias("campaign_type"), _pick(k, CONTENT_TYPES).alias("content_type"),
        F.when(k % 8 == 0, "support_ticket").when(k % 2 == 0, "proactive").otherwise("reactive").alias("interaction_type"),
        ((k % 11) / 10.0).alias("engagement_score"), (k % 48).cast("double").alias("delay_hours"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("total_deposits"),
        F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(0.0)).alias("total_withdrawals"),
        F.sum("o_totalprice").alias("total_bets"), F.count("*").alias("bet_count"),
        F.avg((F.col("o_orderpriority") < "3").cast("double")).alias("win_share"),
        F.min("o_orderdate").cast("timestamp").alias("registration_date"), F.max("o_orderdate").cast("timestamp").alias("last_activity"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("cluster_id"), F.col("c_acctbal").alias("balance"))
    return people.join(orders, people.id == orders.o_custkey).drop("o_custkey").withColumn("win_rate", F.col("win_share") * 100).drop("win_share")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("campaign_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "push").when(F.col("s_suppkey") % 3 == 1, "email").otherwise("sms").alias("campaign_type"))


def campaign_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    when = F.col("l_shipdate").cast("timestamp")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("campaign_id"), F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("send_id"), F.col("l_linenumber").alias("send_part"),
        F.col("o_orderdate").cast("timestamp").alias("sent_at"), F.when(F.col("l_returnflag") != "N", when).alias("opened_at"),
        F.when(F.col("l_returnflag") == "A", when).alias("clicked_at"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), when).alias("converted_at"), F.col("l_extendedprice").alias("conversion_value"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("game_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("provider"),
        (0.9 + F.col("p_size") / 500.0).alias("rtp"), F.when(F.col("p_size") % 3 == 0, "low").when(F.col("p_size") % 3 == 1, "medium").otherwise("high").alias("volatility"),
        F.col("p_retailprice").alias("min_bet"), (F.col("p_retailprice") * 3).alias("max_bet"), (10.0 + F.col("p_size")).alias("avg_session_duration"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")).alias("release_date"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("game_id")).agg(F.sum("l_quantity").alias("rating"), F.sum("l_extendedprice").alias("revenue"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# --- the same views for DuckDB -----------------------------------------------------------------------------


def _case(column: str, values: list[str]) -> str:
    return f"case {column} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_KIND = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items()) + " end"
_K = "(select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events)"
TX = f"""tx as (select event_id as transaction_id, user_id, value as amount, ts as created_at, {_KIND} as transaction_type,
  case when k % 10 = 0 then 'failed' else 'completed' end as status, {_case('k', GAME_TYPES)} as game_type, {_case('k', CHANNELS)} as channel, {_case('k', DEVICES)} as device from {_K})"""
BETS = f"""bets as (select event_id, user_id, ts as timestamp, value as bet_amount, value * (k % 3) * 0.7::double as win_amount,
  case when event_type = 'purchase' then value end as deposit_amount, 60.0::double * (1 + k % 45) as session_duration, cast(1 + k % 9 as bigint) as games_played,
  {_case('k', GAME_TYPES)} as game_type, cast(k % 4 = 0 as int) as promotion_used from {_K})"""
INTER = f"""inter as (select event_id, user_id, ts as timestamp, {_case('k', CHANNELS)} as channel, cast(k % 5 = 0 as int) as responded, {_case('k', CAMPAIGN_TYPES)} as campaign_type,
  {_case('k', CONTENT_TYPES)} as content_type, case when k % 8 = 0 then 'support_ticket' when k % 2 = 0 then 'proactive' else 'reactive' end as interaction_type,
  (k % 11) / 10.0::double as engagement_score, cast(k % 48 as double) as delay_hours from {_K})"""
USERS = """users as (select c_custkey as id, c_name as name, c_mktsegment as segment, cast(c_nationkey as bigint) as cluster_id, c_acctbal as balance,
  sum(case when o_orderstatus = 'F' then o_totalprice else 0.0::double end) as total_deposits, sum(case when o_orderstatus = 'P' then o_totalprice else 0.0::double end) as total_withdrawals,
  sum(o_totalprice) as total_bets, count(*) as bet_count, 100 * avg(case when o_orderpriority < '3' then 1.0::double else 0.0::double end) as win_rate,
  min(o_orderdate) as registration_date, max(o_orderdate) as last_activity
  from customer join orders on c_custkey = o_custkey group by c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal)"""
CAMPAIGNS = "campaigns as (select s_suppkey as campaign_id, s_name as name, case when s_suppkey % 3 = 0 then 'push' when s_suppkey % 3 = 1 then 'email' else 'sms' end as campaign_type from supplier)"
RESULTS = """results as (select l_suppkey as campaign_id, o_custkey as user_id, l_orderkey as send_id, l_linenumber as send_part, o_orderdate as sent_at,
  case when l_returnflag <> 'N' then l_shipdate end as opened_at, case when l_returnflag = 'A' then l_shipdate end as clicked_at,
  case when l_returnflag = 'A' and l_linestatus = 'F' then l_shipdate end as converted_at, l_extendedprice as conversion_value from lineitem join orders on l_orderkey = o_orderkey)"""
GAMES = """games as (select p_partkey as game_id, p_name as name, p_type as category, p_brand as provider, 0.9::double + p_size / 500.0::double as rtp,
  case when p_size % 3 = 0 then 'low' when p_size % 3 = 1 then 'medium' else 'high' end as volatility, p_retailprice as min_bet, p_retailprice * 3 as max_bet, 10.0::double + p_size as avg_session_duration, date '2023-01-01' + cast(p_partkey % 700 as int) as release_date from part)"""
RATINGS = """ratings as (select o_custkey as user_id, l_partkey as game_id, sum(l_quantity) as rating, sum(l_extendedprice) as revenue from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""
