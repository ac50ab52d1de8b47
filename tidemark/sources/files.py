"""Scans of lake files and tables."""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import StateLog

# What stands for null in CSV files, and known file endings.
NULLS = ["", "NULL", "null", "None", "nan"]
FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "feather": "feather"}


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, text_schema: bool = False) -> DataFrame:
    """A scan of one format. CSV null words become null; JSON documents are flattened to columns named a.b; Feather
    files (Arrow IPC) are read one per task. CSV without a schema is read as strings, which saves a pass."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if fmt == "csv":
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        df = (reader.schema(schema) if schema and not text_schema else reader).csv(path)
        return df.select(*[F.when(~F.col(f"`{c}`").isin(NULLS), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    if fmt in ("json", "jsonl"):
        reader = spark.read.option("multiLine", fmt == "json")
        return flatten(reader.schema(schema).json(path) if schema else reader.json(path))
    if fmt == "feather":
        if schema is None:
            raise ValueError("a schema is required for feather files")
        files = spark.read.format("binaryFile").load(path).select("content")

        def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    with pa.ipc.open_file(io.BytesIO(content.as_py())) as file:
                        for i in range(file.num_record_batches):
                            yield file.get_batch(i)

        return files.mapInArrow(tables, schema)
    raise ValueError(f"format {fmt!r}")


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as columns named with dots, at any depth."""
    while any(isinstance(f.dataType, StructType) for f in df.schema):
        df = df.select(*[c for f in df.schema for c in ([F.col(f"`{f.name}`").getField(x.name).alias(f"{f.name}.{x.name}") for x in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f"`{f.name}`")])])
    return df


def list_lake_files(spark: SparkSession, path: str, as_of: dt.datetime, days_back: int = 7, least_age_minutes: int = 5, most_age_days: int = 30, most_mb: float = 500.0) -> DataFrame:
    """(path, bytes, modified, format, age_hours) of files of known format, age and size; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    at = F.lit(as_of).cast("timestamp")
    rows = files.withColumn("format", known[ending]).withColumn("age_hours", (at.cast("double") - F.col("modified").cast("double")) / 3600)
    return rows.where(F.col("format").isNotNull() & (F.col("age_hours") * 60 >= least_age_minutes) & (F.col("age_hours") <= 24 * min(days_back, most_age_days)) & (F.col("bytes") <= most_mb * 1024 * 1024))


def lake_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("format").agg(F.count("*").alias("files"), (F.sum("bytes") / 1024 / 1024).alias("mb"), F.avg("age_hours").alias("avg_age"), F.min("age_hours").alias("least_age"), F.max("age_hours").alias("most_age"))


def extract_all(frames: list[DataFrame], keys: list[str], order_by: str) -> DataFrame:
    """Rows of all frames on the columns that they share, with their file; of one key the last in the order stays."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    union = reduce(DataFrame.unionByName, [f.select(*shared, F.col("_metadata.file_path").alias("_source_file")) for f in frames])
    w = Window.partitionBy(*keys).orderBy(F.desc(order_by), F.desc("_source_file"))
    return union.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extract_recent(df: DataFrame, ts: str, as_of: dt.datetime, hours: int) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of) - F.expr(f"interval {hours} hours"))


def extract_transactions(df: DataFrame, start: dt.datetime, end: dt.datetime, statuses: list[str] | None = None, kinds: list[str] | None = None, low: float | None = None) -> DataFrame:
    """Filters that reach the scan."""
    rows = df.where(F.col("created_at").between(F.lit(start), F.lit(end)) & F.col("user_id").isNotNull())
    rows = rows.where(F.col("status").isin(statuses)) if statuses else rows
    rows = rows.where(F.col("transaction_type").isin(kinds)) if kinds else rows
    return rows.where(F.col("amount") >= low) if low is not None else rows


def extract_by_users(df: DataFrame, ids: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Semi join; Spark broadcasts the ids where they are few by its statistics."""
    return extract_recent(df, "created_at", as_of, 24 * days).join(ids.select("user_id").distinct(), "user_id", "left_semi")


def extract_incremental(df: DataFrame, ts: str, since: dt.datetime | None, as_of: dt.datetime) -> DataFrame:
    return df.where((F.col(ts) > F.lit(since or as_of - dt.timedelta(hours=24))) & (F.col(ts) <= F.lit(as_of)))


def extract_increment(df: DataFrame, ts: str, log: StateLog, sink: Callable[[DataFrame], None], first: dt.datetime | None = None) -> int:
    """Hands the rows after the log's high-water mark (after ``first``, or all, where there is none yet) to the sink, up to the
    largest time that there is as it begins, and moves the mark once the sink is done: a failed sink gets them again.
    Rows without a time are never extracted. Returns their number."""
    entry = log.last()
    since = dt.datetime.fromisoformat(entry[1]) if entry else first
    new = df.where(F.col(ts) > F.lit(since)) if since is not None else df.where(F.col(ts).isNotNull())
    one = new.agg(F.max(ts).alias("until"), F.count("*").alias("n")).first()
    if one.n:
        sink(new.where(F.col(ts) <= F.lit(one.until)))
        log.put(entry[0] + 1 if entry else 0, one.until.isoformat())
    return one.n


def normalize_transactions(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renamed and coerced, without rows that lack user or amount, with parts of the time."""
    rows = df.withColumnsRenamed(mapping).withColumns({"amount": F.col("amount").try_cast("double"), "created_at": F.col("created_at").try_cast("timestamp")}).dropna(subset=["user_id", "amount"])
    return rows.withColumns({"hour": F.hour("created_at"), "weekday": F.weekday("created_at"), "is_weekend": F.weekday("created_at") >= 5, "month": F.month("created_at"), "quarter": F.quarter("created_at")})
