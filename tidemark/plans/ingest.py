"""Queries of sources, sinks and streams: driver tables are written to the shared folder, read again or streamed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import segments
from ..sources import buckets, files, sinks
from ..sources.shared import StateLog, folder, written
from ..streaming import ingest as k
from ..streaming import stateful
from . import views as v
from .registry import query

_AT = "timestamp '2024-01-31 00:00:00'"


@query("select c_custkey::varchar as c_custkey, c_name, case when c_custkey % 5 = 0 then null else c_mktsegment end as c_mktsegment from customer")
def read_csv(spark, sf):
    path = folder(spark, "csv")
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, "nan").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    rows.write.option("header", True).csv(path)
    return files.read_files(spark, path, "csv")


@query('select n_nationkey::bigint as "nation.key", n_name as "nation.name", n_regionkey::bigint as region from nation')
def read_jsonl(spark, sf):
    path = folder(spark, "jsonl")
    v.table(spark, sf, "nation").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), F.col("n_regionkey").alias("region")).write.json(path)
    return files.read_files(spark, path, "jsonl", "nation struct<key:long,name:string>, region long")


@query("select event_id, user_id from events where value > 100")
def read_parquet(spark, sf):
    return files.read_files(spark, f"{sf}/events.parquet").where("value > 100").select("event_id", "user_id")


def _lake(spark, sf):
    """Event days as files of two formats, beside files that are no data, and the time an hour from now."""
    path = folder(spark, "lake-files")
    events = v.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    events.groupBy("day").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/parquet")
    events.groupBy("user_id").agg(F.count("*").alias("n")).coalesce(1).write.csv(f"{path}/csv")
    events.select(F.col("event_type")).distinct().coalesce(1).write.text(f"{path}/text")
    return files.list_lake_files(spark, path, dt.datetime.now() + dt.timedelta(hours=1))


@query("select 'parquet' as format, count(distinct cast(ts as date)) > 0 as filled from events union all select 'csv', count(distinct user_id) > 0 from events")
def list_lake_files(spark, sf):
    return _lake(spark, sf).where("age_hours between 0.9 and 3").select("format", (F.col("bytes") > 0).alias("filled"))


@query("select format, 1::bigint as files, true as small, true as recent from (values ('parquet'), ('csv')) t(format) where (select count(*) from events) > 0")
def lake_stats(spark, sf):
    return files.lake_stats(_lake(spark, sf)).select("format", "files", (F.col("mb") < 500).alias("small"), (F.col("most_age") < 3).alias("recent"))


@query('select n_nationkey::bigint as "nation.key", n_name as "nation.name", n_regionkey::bigint as region from nation')
def read_json(spark, sf):
    path = folder(spark, "json")
    rows = v.table(spark, sf, "nation").select(F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), F.col("n_regionkey").alias("region"))).alias("value"))
    rows.groupBy().agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)  # 25 rows, one document
    return files.read_files(spark, path, "json", "nation struct<key:long,name:string>, region long")


@query("select count(*) as n, sum(c_acctbal) + count(*) as balance from customer", (), "balance")
def load_replace(spark, sf):
    path = folder(spark, "replace")
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sinks.load(rows, path, "append")
    sinks.load(rows.withColumn("c_acctbal", F.col("c_acctbal") + 1), path, "overwrite")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("select c_custkey, c_acctbal from customer", (), "c_acctbal")
def restore_latest(spark, sf):
    """Two snapshots, an old one that expires, and the newest back."""
    path, rows = folder(spark, "snapshots"), v.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sinks.snapshot_table(rows.withColumn("c_acctbal", F.lit(0.0)), path, dt.datetime(2024, 1, 1))
    sinks.snapshot_table(rows, path, dt.datetime(2024, 3, 1))
    if len(sinks.expire_snapshots(rows, path, dt.datetime(2024, 3, 2))) != 1:
        raise ValueError("one snapshot was to expire")
    return sinks.restore_latest(rows, path)


@query("select 'predictions' as topic, user_id::varchar as key, user_id, value as score from events", (), "score")
def to_messages(spark, sf):
    sent = sinks.to_messages(v.table(spark, sf, "events").select("user_id", F.col("value").alias("score")), "user_id", "predictions")
    return sent.select("topic", "key", F.from_json("value", "user_id long, score double").alias("v")).select("topic", "key", "v.*")


@query(" select count(*) as extracted, count(*) filter (where amount > 10) as cleaned, count(*) filter (where amount > 10) as transformed, count(*) filter (where amount > 10) as loaded, count(*) filter (where amount > 10) / count(*) as success_rate from tx", (v.TX,), "success_rate")
def run_report(spark, sf):
    """Counters of one pass over what is read, and of what was written. (An ``Observation`` would leave the session unable to
    send the tree models of pyspark.ml to tasks.)"""
    tx = v.transactions(spark, sf)
    path, began = folder(spark, "run"), dt.datetime.now()
    sinks.load(tx.where("amount > 10").withColumn("fee", F.col("amount") * 0.01), path)
    read = tx.agg(F.count("*").alias("extracted"), F.count_if(F.col("amount") > 10).alias("cleaned")).first()
    done = spark.read.parquet(path).agg(F.count("fee").alias("transformed"), F.count("*").alias("loaded")).first()
    counts = read.asDict() | done.asDict()
    return sinks.run_report(counts, (dt.datetime.now() - began).total_seconds(), spark).drop("seconds", "rows_per_second")


@query(" select user_id, 'bets' as \"table\", count(*) as records from bets where user_id % 100 = 0 group by user_id union all select user_id, 'interactions', count(*) from inter where user_id % 100 = 0 and responded = 1 group by user_id", (v.BETS, v.INTER))
def export_subject(spark, sf):
    """Records of the stated subjects, written by table and read again."""
    path = folder(spark, "subject")
    frames = {"bets": v.bets(spark, sf), "interactions": v.interactions(spark, sf).where("responded = 1")}
    ids = v.bets(spark, sf).where("user_id % 100 = 0").select("user_id")
    sinks.export_subject(frames, ids).write.partitionBy("table").json(path)
    back = spark.read.schema("user_id long, record string, `table` string").json(path)
    return back.where(F.from_json("record", "user_id long")["user_id"] == F.col("user_id")).groupBy("user_id", "table").agg(F.count("*").alias("records"))


@query(", e as (select campaign_id, user_id, 'delivered' as status, sent_at as t, 1 p from results union all select campaign_id, user_id, 'opened', opened_at, 2 from results where opened_at is not null and campaign_id % 7 <> 0), r as (select *, row_number() over (partition by campaign_id, user_id order by p desc, t) n from e) select campaign_id, user_id, status from r where n = 1", (v.RESULTS,))
def apply_webhooks(spark, sf):
    r = v.campaign_results(spark, sf)
    events = r.where("opened_at is not null").select(F.concat(F.lit("c"), "campaign_id").alias("campaign_ext"), F.concat(F.lit("u"), "user_id").alias("user_ext"), F.lit("opened").alias("status"), F.col("opened_at").alias("at"))
    campaigns = v.campaigns(spark, sf).where("campaign_id % 7 <> 0").select(F.concat(F.lit("c"), "campaign_id").alias("campaign_ext"), "campaign_id")
    users = v.users(spark, sf).select(F.concat(F.lit("u"), "id").alias("user_ext"), F.col("id").alias("user_id"))
    have = r.select("campaign_id", "user_id", F.lit("delivered").alias("status"), F.col("sent_at").alias("at"))
    return sinks.apply_webhooks(have, events, campaigns, users).select("campaign_id", "user_id", "status")


@query("select user_id, max(day) as day, count(*) as n from (select distinct user_id, cast(ts as date) as day from events) group by user_id")
def extract_all(spark, sf):
    path = folder(spark, "lake")
    events = v.table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    events.where("event_id % 2 = 0").drop("value").write.parquet(f"{path}/a")
    events.where("event_id % 2 = 1").write.parquet(f"{path}/b")
    rows = files.extract_all([files.read_files(spark, f"{path}/a"), files.read_files(spark, f"{path}/b")], ["user_id", "day"], "event_id")
    return rows.groupBy("user_id").agg(F.max("day").alias("day"), F.count("*").alias("n"))


@query(f" select transaction_id from tx where created_at >= {_AT} - interval 48 hours", (v.TX,))
def extract_recent(spark, sf):
    return files.extract_recent(v.transactions(spark, sf), "created_at", v.EVENTS_AS_OF, 48).select("transaction_id")


@query(" select transaction_id from tx where created_at between timestamp '2024-01-05' and timestamp '2024-01-10' and user_id is not null and status in ('completed') and transaction_type in ('bet', 'win') and amount >= 10", (v.TX,))
def extract_transactions(spark, sf):
    return files.extract_transactions(v.transactions(spark, sf), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10), ["completed"], ["bet", "win"], 10.0).select("transaction_id")


@query(f" select transaction_id from tx where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING') and created_at >= {_AT} - interval 240 hours", (v.TX,))
def extract_by_users(spark, sf):
    ids = v.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return files.extract_by_users(v.transactions(spark, sf), ids, v.EVENTS_AS_OF, 10).select("transaction_id")


@query(f" select transaction_id from tx where created_at > timestamp '2024-01-29' and created_at <= {_AT}", (v.TX,))
def extract_incremental(spark, sf):
    return files.extract_incremental(v.transactions(spark, sf), "created_at", dt.datetime(2024, 1, 29), v.EVENTS_AS_OF).select("transaction_id")


@query("select event_id, value as amount, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as weekday, isodow(ts) >= 6 as is_weekend, cast(month(ts) as int) as month, cast(quarter(ts) as int) as quarter from events where user_id is not null and value is not null", (), "amount")
def normalize_transactions(spark, sf):
    rows = v.table(spark, sf, "events").withColumn("value", F.col("value").cast("string"))
    return files.normalize_transactions(rows, {"value": "amount", "ts": "created_at"}).select("event_id", "amount", "hour", "weekday", "is_weekend", "month", "quarter")


@query("select c_custkey, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_name from customer union all select c_custkey + 1000000, c_acctbal + 1, null from customer where c_custkey % 2 = 0", (), "c_acctbal")
def merge_upsert(spark, sf):
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name")
    some = rows.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return sinks.merge_upsert(rows, some.unionByName(some.withColumn("c_custkey", F.col("c_custkey") + 1000000)), "c_custkey")


@query("select count(*) * 2 as n, sum(c_acctbal) * 2 as balance from customer", (), "balance")
def load_append(spark, sf):
    path = folder(spark, "load")
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    sinks.load(rows, path, "overwrite", v.ORDERS_AS_OF)
    sinks.load(rows, path, "append", v.ORDERS_AS_OF)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("select c_custkey, cast(null as varchar) as email, c_acctbal, c_name from customer", (), "c_acctbal")
def align_schema(spark, sf):
    return sinks.align_schema(v.table(spark, sf, "customer").select("c_name", "c_acctbal", "c_custkey"), {"c_custkey": "bigint", "email": "string", "c_acctbal": "double"})


@query("select coalesce(c_acctbal, 0) as c_acctbal, 0.0::double as bonus from customer", (), "c_acctbal bonus")
def align_features(spark, sf):
    return sinks.align_features(v.table(spark, sf, "customer"), ["c_acctbal", "bonus"])


@query("select count(*) as rows, cast(1 as int) as missing_columns, count(*) filter (where length(text) > 10000) + count(*) filter (where length(lang) > 10000) + count(*) filter (where length(source) > 10000) as long_strings, count(doc_id) - count(distinct doc_id) as duplicate_keys, false as ok from documents")
def preload_checks(spark, sf):
    return sinks.preload_checks(v.table(spark, sf, "documents"), "doc_id", ["doc_id", "title"])


@query("select count(*) as rows, count(*) filter (where user_id is null) as null_keys, count(*) filter (where user_id is null) = 0 as ok from events")
def postload_checks(spark, sf):
    return sinks.postload_checks(v.table(spark, sf, "events"), "user_id")


@query("select c_custkey from customer where c_mktsegment <> 'BUILDING' and c_custkey % 3 = 0")
def apply_updates(spark, sf):
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return sinks.apply_updates(rows, rows.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("BUILDING")), "c_custkey")[1]


@query("select 'customer' as \"table\", 'c_name' as field, 'identity' as category, 730 as retention_days, count(*) as rows, count(c_name) as filled from customer union all select 'customer', 'c_acctbal', 'financial', 1825, count(*), count(c_acctbal) from customer union all select 'orders', 'o_totalprice', 'financial', 1825, count(*), count(o_totalprice) from orders")
def data_inventory(spark, sf):
    return _inventory(spark, sf).select("table", "field", "category", "retention_days", "rows", "filled")


def _inventory(spark, sf):
    frames = {"customer": v.table(spark, sf, "customer").select("c_name", "c_acctbal"), "orders": v.table(spark, sf, "orders").select("o_totalprice")}
    return written(sinks.inventory_values(frames, {"name": ("identity", 730), "acct": ("financial", 1825), "price": ("financial", 1825)}), "inventory")


@query("select 'customer' as \"table\", 'contract' as legal_basis, 'accounts' as purpose, 'financial,identity' as categories, 2 as fields, 1825 as retention_days, count(*) as rows from customer union all select 'orders', 'unknown', 'unknown', 'financial', 1, 1825, count(*) from orders")
def processing_register(spark, sf):
    """Legal basis, categories and retention of tables, with their rows."""
    fields = _inventory(spark, sf)
    return sinks.processing_register(fields, {"customer": ("contract", "accounts")}).join(fields.groupBy("table").agg(F.max("rows").alias("rows")), "table")


@query(" select user_id, 'bets' as \"table\", count(*) as records, count(deposit_amount) as filled, sum(bet_amount) as amount, '' as words from bets where user_id % 100 = 0 group by user_id union all select user_id, 'interactions', count(*), 0, sum(engagement_score), string_agg(distinct channel, ',' order by channel) from inter where user_id % 100 = 0 group by user_id", (v.BETS, v.INTER), "amount")
def export_subject_csv(spark, sf):
    """CSV records of the stated subjects, written by table, and read again with their headers."""
    path = folder(spark, "subject-csv")
    frames = {"bets": v.bets(spark, sf), "interactions": v.interactions(spark, sf)}
    sinks.export_subject(frames, v.bets(spark, sf).where("user_id % 100 = 0").select("user_id"), fmt="csv").write.partitionBy("table").parquet(path)
    back, out = spark.read.schema("user_id long, record string, `table` string").parquet(path), None
    for table, header in sinks.csv_headers(frames).items():
        amount, filled, words = ("bet_amount", "deposit_amount", F.lit("")) if table == "bets" else ("engagement_score", None, F.array_join(F.array_sort(F.collect_set("x.channel")), ","))
        schema = ", ".join(f"`{c}` {'long' if c == 'user_id' else 'string'}" for c in header.split(","))
        rows = back.where(F.col("table") == table).withColumn("x", F.from_csv("record", schema)).where("x.user_id = user_id")
        one = rows.groupBy("user_id", "table").agg(F.count("*").alias("records"), (F.count(f"x.{filled}") if filled else F.lit(0).cast("long")).alias("filled"), F.sum(F.col(f"x.{amount}").cast("double")).alias("amount"), words.alias("words"))
        out = one if out is None else out.unionByName(one)
    return out


# --- streams -----------------------------------------------------------------------------------------------


def _messages(spark, sf):
    """Events as messages of two topics; some payloads are broken and some lack a field."""
    events = v.table(spark, sf, "events")
    body = F.to_json(F.struct("user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.col("ts").cast("string").alias("timestamp"), F.col("value").alias("amount")))
    return events.select(F.when(F.col("event_id") % 3 == 0, "other").otherwise("user-events").alias("topic"), F.col("event_id").alias("offset"), F.when(F.col("event_id") % 17 == 0, "{broken").otherwise(body).alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))


_SCHEMA = "user_id long, event_type string, timestamp string, amount double"


@query("select event_id as \"offset\" from events where event_id % 17 <> 0 and event_id % 3 <> 0 and event_id % 11 <> 0")
def valid_messages(spark, sf):
    return k.split_dlq(k.validate_topics(k.decode(_messages(spark, sf), _SCHEMA)))[0].select("offset")


@query("select event_id as \"offset\", event_id % 17 = 0 as broken from events where event_id % 17 = 0 or event_id % 3 = 0 or event_id % 11 = 0")
def dead_letters(spark, sf):
    return k.split_dlq(k.validate_topics(k.decode(_messages(spark, sf), _SCHEMA)))[1].select("offset", F.col("raw_data").isNotNull().alias("broken"))


def _streamed(spark, sf, name: str, plan, mode: str = "append"):
    """Transactions as a file stream through a plan, worked off once, as a table."""
    source, out, checkpoint = folder(spark, f"{name}-in"), folder(spark, f"{name}-out"), folder(spark, f"{name}-offsets")
    v.transactions(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(v.transactions(spark, sf).schema).parquet(source)
    made = plan(stream)
    if mode == "append":
        done = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        done = made.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query(", w as (select time_bucket(interval 1 hour, created_at) as start, transaction_type, count(*) as n, sum(amount) as amount from tx group by 1, 2) select * from w where start + interval 1 hour <= (select max(created_at) from tx) - interval 1 hour", (v.TX,), "amount")
def windowed_counts(spark, sf):
    out = _streamed(spark, sf, "windows", lambda df: k.windowed_counts(df, "created_at", ["transaction_type"], "1 hour", "30 seconds"))
    last = v.transactions(spark, sf).agg(F.max("created_at").alias("_m"))
    closed = out.crossJoin(F.broadcast(last)).where(F.col("start") + F.expr("interval 1 hour") <= F.col("_m") - F.expr("interval 1 hour"))
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "transaction_type", "n", "amount")


@query(" select user_id, count(*) filter (where transaction_type = 'bet') as bets, count(*) filter (where transaction_type = 'deposit') as deposits, count(*) filter (where transaction_type = 'withdrawal') as withdrawals, max(created_at) as last_activity from tx group by user_id", (v.TX,))
def activity_counters(spark, sf):
    out = _streamed(spark, sf, "counters", k.activity_counters, "complete")
    return out.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


@query(" select user_id, count(*) filter (where transaction_type = 'bet') as bets, count(*) filter (where transaction_type = 'deposit') as deposits, count(*) filter (where transaction_type = 'withdrawal') as withdrawals, max(created_at) as last_activity from tx group by user_id", (v.TX,))
def apply_activity(spark, sf):
    tx = v.transactions(spark, sf)
    half = F.col("created_at") < F.lit(dt.datetime(2024, 1, 15))
    out = k.apply_activity(k.activity_counters(tx.where(half)), k.activity_counters(tx.where(~half)))
    return out.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


@query(" select count(distinct (channel, device, user_id)) as n from tx", (v.TX,))
def dedup_stream(spark, sf):
    out = _streamed(spark, sf, "dedup", lambda df: k.dedup_stream(df, "created_at", ("channel", "device", "user_id"), "60 days"))
    return out.agg(F.count("*").alias("n"))


@query(", e as (select campaign_id, user_id, 'delivered' as status, sent_at as t, 1 p from results union all select campaign_id, user_id, 'opened', opened_at, 2 from results where opened_at is not null union all select campaign_id, user_id, 'clicked', clicked_at, 3 from results where clicked_at is not null union all select campaign_id, user_id, 'converted', converted_at, 4 from results where converted_at is not null), r as (select *, row_number() over (partition by campaign_id, user_id order by p desc, t) n from e) select campaign_id, user_id, status from r where n = 1", (v.RESULTS,))
def furthest_status(spark, sf):
    r = v.campaign_results(spark, sf)
    rows = None
    for status, c in zip(k.STATUS_ORDER, ("sent_at", "opened_at", "clicked_at", "converted_at"), strict=True):
        one = r.where(F.col(c).isNotNull()).select("campaign_id", "user_id", F.lit(status).alias("status"), F.col(c).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    return k.furthest_status(rows, ["campaign_id", "user_id"]).select("campaign_id", "user_id", "status")


@query("select o_custkey as user_id, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 2")
def best_orders(spark, sf):
    return segments.top_k_per(v.table(spark, sf, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select(F.col("o_custkey").alias("user_id"), "o_orderkey")


@query(" select user_id, count(*) as n, sum(amount) as amount from tx group by user_id", (v.TX,), "amount")
def process_batches(spark, sf):
    """Micro-batches of a file stream through a handler, worked off once; a batch writes its own part, so that a repeated one
    counts once."""
    source, out, checkpoint = folder(spark, "process-in"), folder(spark, "process-out"), folder(spark, "process-offsets")
    tx = v.transactions(spark, sf)
    tx.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(source)
    done = k.process(stream, lambda df, i: df.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).write.mode("overwrite").parquet(f"{out}/part={i}"), checkpoint)
    done.awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


@query(" select count(*) as rows, true as in_batches from tx", (v.TX,))
def stream_metrics(spark, sf):
    """Rows of the progress of a stream."""
    source, checkpoint = folder(spark, "metrics-in"), folder(spark, "metrics-offsets")
    tx = v.transactions(spark, sf)
    tx.repartition(3).write.parquet(source)
    done = k.process(spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(source), lambda df, i: df.write.format("noop").mode("overwrite").save(), checkpoint)
    done.awaitTermination()
    return k.stream_metrics(done.recentProgress, spark).agg(F.sum("rows").alias("rows"), (F.count("*") >= 3).alias("in_batches"))


@query(" select user_id % 3 as part, count(*) as rows, 0 as dropped, true as in_time from tx group by 1", (v.TX,))
def stream_progress(spark, sf):
    """Rows of three streams as a listener has written them."""
    source, out = folder(spark, "progress-in"), folder(spark, "progress-log")
    tx = v.transactions(spark, sf).withColumn("part", F.col("user_id") % 3)
    tx.write.partitionBy("part").parquet(source)
    log = k.ProgressLog(spark, out)
    spark.streams.addListener(log)
    try:
        names, in_time = [], True
        for part in range(3):
            stream = spark.readStream.schema(tx.drop("part").schema).parquet(f"{source}/part={part}")
            done = k.process(stream, lambda df, i: df.write.format("noop").mode("overwrite").save(), folder(spark, "progress-offsets"))
            done.awaitTermination()
            in_time = log.wait(done) and in_time
            names.append((part, done.id))
    finally:
        spark.streams.removeListener(log)
    rows = log.rows().join(F.broadcast(spark.createDataFrame(names, "part long, query string")), "query")
    return rows.groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("dropped").alias("dropped"), F.lit(in_time).alias("in_time"))


@query(", f as (select user_id, max(created_at) as u, count(*) as n from tx where created_at < timestamp '2024-01-25' group by 1) select transaction_id, case when f.u >= tx.created_at - interval 3 days then n end as stored_n from tx left join f on f.user_id = tx.user_id where tx.created_at >= timestamp '2024-01-25'", (v.TX,))
def enrich_stream(spark, sf):
    tx = v.transactions(spark, sf)
    split = F.lit(dt.datetime(2024, 1, 25))
    features = tx.where(F.col("created_at") < split).groupBy("user_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("stored_n"))
    return _streamed(spark, sf, "enrich", lambda df: k.enrich_stream(df.where(F.col("created_at") >= split), features, "created_at", "3 days").select("transaction_id", "stored_n"))


@query()
def online_kmeans(spark, sf):
    """Labels of all transactions by centres that a stream of them has moved."""
    source, checkpoint = folder(spark, "online-in"), folder(spark, "online-offsets")
    tx = v.transactions(spark, sf).withColumn("hour", F.hour("created_at"))
    tx.repartition(4, "transaction_id").write.parquet(source)
    model = k.OnlineKMeans(3, ["amount", "hour"], per_version=2, log=StateLog(spark, folder(spark, "online-log")))
    k.process(spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(source), model.learn, checkpoint).awaitTermination()
    return model.predict(tx).select("transaction_id", "label", "confidence", F.lit(model.version).alias("version"))


@query()
def score_stream(spark, sf):
    from ..operators import clustering

    tx = v.transactions(spark, sf)
    rows = tx.select("transaction_id", F.array(F.col("amount"), F.hour("created_at").cast("double")).alias("features"))
    model = clustering.kmeans(rows, 3)[0]
    return _streamed(spark, sf, "score", lambda df: k.score_stream(df.withColumn("hour", F.hour("created_at")), model, ["amount", "hour"]).select("transaction_id", "label", "distance", "confidence"))


@query(" select count(*) as rows, sum(case when status = 'failed' then 1 else 0 end)::bigint as failed from tx", (v.TX,))
def quality_monitor(spark, sf):
    source, out, checkpoint = folder(spark, "monitor-in"), folder(spark, "monitor-out"), folder(spark, "monitor-offsets")
    tx = v.transactions(spark, sf)
    tx.repartition(3).write.parquet(source)
    handler = k.quality_monitor(out, lambda df: df.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "failed").alias("failed")))
    k.process(spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(source), handler, checkpoint).awaitTermination()
    return spark.read.parquet(out).agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"))


@query("""select c_custkey, case when c_custkey % 6 = 0 then c_acctbal + 2 when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 10 = 3 then 'CHANGED' else c_mktsegment end as c_mktsegment,
  case when c_custkey % 7 = 0 then timestamp '2024-01-31' end as deleted_at from customer where c_custkey % 11 <> 0 union all select c_custkey + 1000000, c_acctbal + 1, null, null from customer where c_custkey % 2 = 0""", (), "c_acctbal")
def stored_upserts(spark, sf):
    """A stored table after upserts in two batches (one handed over twice), a partial update, soft and hard deletion."""
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.lit(None).cast("timestamp").alias("deleted_at"))
    table = buckets.BucketTable.create(rows, folder(spark, "stored-upserts"), "c_custkey", 16)
    some = rows.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    first = some.unionByName(some.withColumn("c_custkey", F.col("c_custkey") + 1000000))
    table = table.upsert(first, batch=0).upsert(first.withColumn("c_acctbal", F.lit(0.0)), batch=0)
    twice = rows.where("c_custkey % 6 = 0").select("c_custkey", F.explode(F.array(F.lit(2), F.lit(1))).alias("step"), "c_acctbal").withColumn("c_acctbal", F.col("c_acctbal") + F.col("step"))
    table = table.upsert(twice, order="step", batch=1)
    table = table.update(rows.where("c_custkey % 10 = 3").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal")))
    table = table.delete(rows.where("c_custkey % 7 = 0"), dt.datetime(2024, 1, 31)).delete(rows.where("c_custkey % 11 = 0"))
    table.vacuum(1)
    return table.read().withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))


@query(" select user_id, count(*) filter (where transaction_type = 'bet') as bets, count(*) filter (where transaction_type = 'deposit') as deposits, count(*) filter (where transaction_type = 'withdrawal') as withdrawals, max(created_at) as last_activity from tx group by user_id", (v.TX,))
def stored_activity(spark, sf):
    """Counters that a stream's micro-batches add to a stored table."""
    tx = v.transactions(spark, sf)
    source, at, checkpoint = folder(spark, "activity-in"), folder(spark, "activity"), folder(spark, "activity-offsets")
    tx.select("transaction_id", "user_id", "transaction_type", "created_at").repartition(3, "transaction_id").write.parquet(source)
    stream = spark.readStream.schema("transaction_id long, user_id long, transaction_type string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    buckets.BucketTable.create(k.activity_counters(tx.limit(0)), at, "user_id", 16)
    add = lambda table, df, batch: table.merge(k.activity_counters(df), k.apply_activity, batch, "activity")
    k.process(stream, buckets.stream_into(at, add), checkpoint).awaitTermination()
    return buckets.BucketTable(spark, at).read().withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


@query(", e as (select campaign_id, user_id, 'delivered' as status, sent_at as t, 1 p from results union all select campaign_id, user_id, 'opened', opened_at, 2 from results where opened_at is not null union all select campaign_id, user_id, 'clicked', clicked_at, 3 from results where clicked_at is not null), r as (select *, row_number() over (partition by campaign_id, user_id order by p desc, t) n from e) select campaign_id, user_id, status from r where n = 1", (v.RESULTS,))
def stored_statuses(spark, sf):
    """The furthest status of each campaign and user, from events that reach a stored table in micro-batches, in any order."""
    r = v.campaign_results(spark, sf)
    parts = []
    for status, at in (("clicked", "clicked_at"), ("delivered", "sent_at"), ("opened", "opened_at")):
        one = r.where(F.col(at).isNotNull()).select("campaign_id", "user_id", F.lit(status).alias("status"), F.col(at).alias("at"))
        parts.append(one.withColumn("pair", F.concat_ws("/", "campaign_id", "user_id")))
    source, at, checkpoint = folder(spark, "status-in"), folder(spark, "status"), folder(spark, "status-offsets")
    buckets.BucketTable.create(parts[0].limit(0), at, "pair", 16)

    def further(old, new):
        both = old.unionByName(new)
        return k.furthest_status(both, ["pair", "campaign_id", "user_id"])

    move = lambda table, df, batch: table.merge(df, further, batch, "statuses")
    for one in parts:  # a micro-batch is all files of one status
        one.write.mode("append").parquet(source)
        k.process(spark.readStream.schema(one.schema).parquet(source), buckets.stream_into(at, move), checkpoint).awaitTermination()
    return buckets.BucketTable(spark, at).read().select("campaign_id", "user_id", "status")


def _folded(spark, sf, name: str, plan):
    """Transactions through a stateful plan that is started again for each of four parts of about a quarter of the time, some rows in
    the part after their own, and for a last row that moves the watermark past all of them. A micro-batch is all files of a part."""
    source, out, checkpoint = folder(spark, f"{name}-in"), folder(spark, f"{name}-out"), folder(spark, f"{name}-offsets")
    tx = v.transactions(spark, sf)
    late = F.when(F.col("transaction_id") % 3 == 0, 12).otherwise(0) * F.expr("interval 1 hour")
    part = F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(F.floor(F.datediff(F.col("created_at") + late, F.lit(dt.date(2024, 1, 1))) / 8), F.lit(0))))
    end = tx.limit(1).select(*[F.lit(dt.datetime(2100, 1, 1)).alias(c) if c == "created_at" else F.lit(-1).cast("long").alias(c) if c == "user_id" else F.lit(0.0).alias(c) if c == "amount" else c for c in tx.columns])
    for rows in (*[tx.where(part == i) for i in range(4)], end):
        rows.write.mode("append").parquet(source)
        with stateful.rocksdb(spark):
            made = plan(spark.readStream.schema(tx.schema).parquet(source))
            run = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query("select transaction_id, user_id, sum(case when transaction_type in ('deposit', 'win') then amount else -amount end) over (partition by user_id order by created_at, transaction_id rows unbounded preceding) as balance from tx", (v.TX,), "balance")
def balances_stream(spark, sf):
    return _folded(spark, sf, "balances", lambda df: stateful.balances(df, "2 days"))


@query(""", b as (select transaction_id, user_id, created_at, lag(amount) over w as amount, lag(created_at) over w as prev from tx window w as (partition by user_id order by created_at, transaction_id))
select transaction_id, user_id, case when epoch_us(created_at) // 1000 - epoch_us(prev) // 1000 <= 43200000 then amount end as last_amount, case when epoch_us(created_at) // 1000 - epoch_us(prev) // 1000 <= 43200000 then (epoch_us(created_at) // 1000 - epoch_us(prev) // 1000) / 1000.0::double end as age from b""", (v.TX,), "last_amount age")
def last_features_stream(spark, sf):
    return _folded(spark, sf, "last", lambda df: stateful.last_features(df, ["amount"], dt.timedelta(hours=12), "2 days"))


_ALERTS = """, low as (select distinct channel as dimension, case when amount / 100 < 0.63 then 'critical' when amount / 100 < 0.765 then 'high' else 'medium' end as severity, created_at as ts from tx where amount / 100 < 0.9),
nxt as (select *, min(ts) over (partition by dimension, severity order by ts range between interval 15 minutes following and unbounded following) as later from low)
"""


@query(f"select * from (with recursive {v.TX} {_ALERTS}, " + "a as (select dimension, severity, min(ts) as raised from low group by 1, 2 union all select n.dimension, n.severity, n.later from a join nxt n on n.dimension = a.dimension and n.severity = a.severity and n.ts = a.raised where n.later is not null) select dimension, severity, raised from a)")
def alerts_stream(spark, sf):
    metrics = lambda df: df.select(F.col("channel").alias("dimension"), F.col("created_at").alias("ts"), (F.col("amount") / 100).alias("score"))
    return _folded(spark, sf, "alerts", lambda df: stateful.alerts(metrics(df), "2 days")).where("raised < timestamp '2099-01-01'").withColumn("raised", F.col("raised").cast("timestamp_ntz"))


@query("select transaction_id, case when created_at <= timestamp '2024-01-10' then 0 when created_at <= timestamp '2024-01-20' then 1 else 2 end as run from tx", (v.TX,))
def extract_increments(spark, sf):
    """Three extractions from a table that grows, by a stored high-water mark; one sink fails and gets its rows again."""
    tx, log, out = v.transactions(spark, sf), StateLog(spark, folder(spark, "marks")), folder(spark, "increments")

    def fails(df):
        raise OSError("sink")

    for run, until in enumerate((dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), dt.datetime(2100, 1, 1))):
        there = tx.where(F.col("created_at") <= F.lit(until))
        if run == 1:
            try:
                files.extract_increment(there, "created_at", log, fails)
            except OSError:
                pass
        files.extract_increment(there, "created_at", log, lambda df, run=run: df.select("transaction_id", F.lit(run).alias("run")).write.mode("append").parquet(out))
    return spark.read.parquet(out)
