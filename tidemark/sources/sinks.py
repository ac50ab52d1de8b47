"""Sinks, checks around a load, and upserts without a table format."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load(df: DataFrame, path: str, mode: str = "overwrite", as_of: dt.datetime | None = None, partition: list[str] | None = None) -> None:
    """Replaces (``overwrite``) or appends; with as_of, rows get created_at and updated_at."""
    if as_of is not None:
        df = df.withColumns({"created_at": F.lit(as_of), "updated_at": F.lit(as_of)})
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def last_of_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: that of the largest ``order``; among equals, and without an order, that of the largest hash."""
    by = F.struct(*([F.col(f"`{order}`")] if order else []), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), by).alias("_row")).select("_row.*")


def merge_upsert(target: DataFrame, source: DataFrame, key: str, as_of: dt.datetime | None = None, order: str | None = None) -> DataFrame:
    """Target after the source: its values win where a key is in both, columns that it lacks stay, new rows join. Of several
    source rows of a key that of the largest ``order`` counts (``last_of_key``)."""
    source = last_of_key(source, key, order)
    s = source.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in source.columns if c != key], F.lit(True).alias("_in"))
    rows = target.join(s, key, "full")
    out = []
    for c in target.columns:
        if c == key:
            out.append(F.col(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(F.col("_in"), F.lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_in"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in source.columns else F.col(c))
    return rows.select(*out)


def align_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of the target schema in order; missing ones are null, extra ones follow."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()], *[c for c in df.columns if c not in columns])


def align_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; missing ones 0, extra ones dropped."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def preload_checks(df: DataFrame, key: str, required: list[str], longest: int = 10_000) -> DataFrame:
    """One row: rows, missing required columns, strings that are too long, doubled keys, and the verdict."""
    strings = [c for c, t in df.dtypes if t == "string"]
    missing = [c for c in required if c not in df.columns]
    long = sum((F.count_if(F.length(c) > longest) for c in strings), F.lit(0))
    one = df.agg(F.count("*").alias("rows"), F.lit(len(missing)).alias("missing_columns"), long.cast("long").alias("long_strings"), (F.count(key) - F.countDistinct(key)).alias("duplicate_keys"))
    return one.withColumn("ok", (F.col("rows") > 0) & (F.col("missing_columns") == 0) & (F.col("long_strings") == 0) & (F.col("duplicate_keys") == 0))


def postload_checks(df: DataFrame, key: str) -> DataFrame:
    one = df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"))
    return one.withColumn("ok", (F.col("rows") > 0) & (F.col("null_keys") == 0))


def apply_updates(target: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Target after the changes, and the keys that really changed."""
    shared = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_c_{x}") for x in shared], F.lit(True).alias("_in"))
    rows = target.join(c, key, "left")
    differs = F.lit(False)
    for x in shared:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"_c_{x}"))
    rows = rows.withColumn("_changed", F.coalesce(F.col("_in"), F.lit(False)) & differs)
    after = rows.select(*[F.when(F.col("_changed"), F.col(f"_c_{x}")).otherwise(F.col(x)).alias(x) if x in shared else F.col(x) for x in target.columns])
    return after, rows.where("_changed").select(key)


def data_inventory(frames: dict[str, DataFrame], policy: dict[str, tuple[str, int]]) -> DataFrame:
    """(table, field, type, category, retention_days) of every column; the category is that of the first policy word in
    the field's name."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for table, df in frames.items():
        for c, t in df.dtypes:
            category, days = next((p for word, p in policy.items() if word in c.lower()), ("other", 365))
            rows.append((table, c, t, category, days))
    return spark.createDataFrame(rows, "`table` string, field string, type string, category string, retention_days int")


def processing_register(inventory: DataFrame, bases: dict[str, tuple[str, str]]) -> DataFrame:
    """(table, legal_basis, purpose, categories, fields, retention_days) of each table of an inventory: its legal basis and purpose
    (``unknown`` where none is stated), the distinct categories in order, and the longest retention of its fields."""
    stated = inventory.sparkSession.createDataFrame([(t, *b) for t, b in bases.items()], "`table` string, legal_basis string, purpose string")
    per = inventory.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("fields"), F.max("retention_days").alias("retention_days"))
    return per.join(stated, "table", "left").select("table", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("legal_basis", "purpose")], "categories", "fields", "retention_days")


def inventory_values(frames: dict[str, DataFrame], policy: dict[str, tuple[str, int]]) -> DataFrame:
    """``data_inventory`` with what the fields hold: rows, filled values, and an estimate (5 %) of different ones."""
    parts = None
    for table, df in frames.items():
        one = df.agg(F.count("*").alias("rows"), *[x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"f{i}"), F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}"))])
        cells = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(c).alias("field"), "rows", F.col(f"f{i}").alias("filled"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(df.columns)])
        rows = one.select(F.inline(cells))
        parts = rows if parts is None else parts.unionByName(rows)
    return data_inventory(frames, policy).join(parts, ["table", "field"])


def snapshot_table(df: DataFrame, folder: str, at: dt.datetime) -> str:
    """Writes the table to a path with the time in its name, and returns that."""
    path = f"{folder.rstrip('/')}/snapshot-{at:%Y%m%dT%H%M%S}"
    df.write.parquet(path)
    return path


def snapshots(df: DataFrame, folder: str) -> list[str]:
    """Paths of the snapshots in the folder, oldest first; df gives the session."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.listStatus(at) if s.getPath().getName().startswith("snapshot-")) if system.exists(at) else []


def restore_latest(df: DataFrame, folder: str) -> DataFrame:
    """The newest snapshot, with df's columns. Raises if there is none."""
    found = snapshots(df, folder)
    if not found:
        raise ValueError(f"no snapshot in {folder}")
    return df.sparkSession.read.schema(df.schema).parquet(found[-1])


def expire_snapshots(df: DataFrame, folder: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    """Deletes the snapshots that are older than ``days``, but never the newest; returns their paths."""
    least = f"snapshot-{as_of - dt.timedelta(days=days):%Y%m%dT%H%M%S}"
    gone = [p for p in snapshots(df, folder)[:-1] if p.rsplit("/", 1)[1] < least]
    for p in gone:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def to_messages(df: DataFrame, key: str, topic: str) -> DataFrame:
    """(topic, key, value): rows as JSON messages, as the Kafka sink takes them from a batch or a stream."""
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(df: DataFrame, servers: str, checkpoint: str | None = None):
    """Messages to Kafka; a stream keeps its offsets in the checkpoint. Needs the Kafka package on the class path."""
    if not df.isStreaming:
        return df.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()


def run_report(counts: dict[str, int], seconds: float, spark) -> DataFrame:
    """One row per run from observed counters (extracted, cleaned, transformed, loaded): seconds, rows a second, success rate."""
    n = counts.get("extracted", 0)
    row = (*[int(counts.get(x, 0)) for x in ("extracted", "cleaned", "transformed", "loaded")], float(seconds), n / seconds if seconds else 0.0, counts.get("loaded", 0) / n if n else 0.0)
    return spark.createDataFrame([row], "extracted long, cleaned long, transformed long, loaded long, seconds double, rows_per_second double, success_rate double")


def export_subject(frames: dict[str, DataFrame], ids: DataFrame, key: str = "user_id", fmt: str = "json") -> DataFrame:
    """(key, table, record): all rows of the subjects as JSON or CSV, a row each, to be written partitioned by table; columns
    that a table lacks don't appear, and subjects without rows have none. Columns are in the order of their names; CSV quotes
    texts that need it, leaves nulls empty, and has arrays, maps and structs as JSON; ``csv_headers`` has its first lines."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"format {fmt!r}")
    mine, out = ids.select(key).distinct(), None
    for table, df in frames.items():
        kinds = dict(df.dtypes)
        flat = [F.to_json(F.col(f"`{c}`")).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in sorted(df.columns)]
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])) if fmt == "json" else F.to_csv(F.struct(*flat))
        one = df.join(mine, key, "left_semi").select(key, F.lit(table).alias("table"), record.alias("record"))
        out = one if out is None else out.unionByName(one)
    return out


def csv_headers(frames: dict[str, DataFrame]) -> dict[str, str]:
    """The header line of each table of a CSV export."""
    return {table: ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if set(c) & set('",\r\n') else c for c in sorted(df.columns)) for table, df in frames.items()}


def apply_webhooks(results: DataFrame, events: DataFrame, campaigns: DataFrame, users: DataFrame) -> DataFrame:
    """results (campaign_id, user_id, status, at) after events (campaign_ext, user_ext, status, at) whose external ids are
    known: of each pair the furthest status wins, the earliest time of that; new pairs join."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("delivered", "opened", "clicked", "converted")]), F.col("status"))
    known = events.join(campaigns.select("campaign_ext", "campaign_id"), "campaign_ext").join(users.select("user_ext", "user_id"), "user_ext").select("campaign_id", "user_id", "status", "at")
    rows = results.select("campaign_id", "user_id", "status", "at").unionByName(known).withColumn("_p", place)
    best = rows.groupBy("campaign_id", "user_id").agg(F.max(F.struct("_p", -F.col("at").cast("double"), "at", "status")).alias("m"))
    return best.select("campaign_id", "user_id", F.col("m.status").alias("status"), F.col("m.at").alias("at"))
