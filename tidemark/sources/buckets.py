"""A table of one row per key that is changed in place of being written anew: keys are dealt in buckets by their hash, a change
reads and writes the buckets it touches, and a small log says of each version which files every bucket has.

A version is there as soon as its log entry is: readers see the one before or the one after, and what a lost writer left
behind is never read. Entries carry the writer's batch number, so that a micro-batch that is handed over again
changes nothing. One writer at a time; a second one fails when it finds its version taken."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written
from .sinks import last_of_key, merge_upsert

LOG = "bucket int, part string, writer string, batch long, fields string, `key` string, buckets int"


class BucketTable:
    """``create`` makes it, the constructor finds it; ``read`` gives its rows, and the other methods make the next version."""

    #: About how many rows a task of a change writes.
    rows_per_task = 500_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        entries = self._versions()
        self.version = entries[-1] if entries else -1
        rows = self.spark.read.schema(LOG).parquet(self._log(self.version)).collect() if entries else []  # a row per bucket and writer
        self.files = {r.bucket: r.part for r in rows if r.bucket is not None}
        self.batches = {r.writer: r.batch for r in rows if r.bucket is None and r.writer is not None}
        about = next((r for r in rows if r.fields), None)
        self.schema = StructType.fromJson(json.loads(about.fields)) if about else None
        self.key, self.buckets = (about.key, about.buckets) if about else (None, 0)

    # --- files

    def _system(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}"

    def _versions(self) -> list[int]:
        at, system = self._system(f"{self.path}/log")
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, version: int, part: str, changed: list[int], gone: list[int], batches: dict[str, int]) -> BucketTable:
        files = {b: v for b, v in self.files.items() if b not in gone} | dict.fromkeys(changed, part)
        about = self.schema.json()
        rows = [(b, v, None, None, None, None, None) for b, v in files.items()] + [(None, None, w, n, None, None, None) for w, n in batches.items()] + [(None, None, None, None, about, self.key, self.buckets)]
        staged = f"{self.path}/log/_{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(staged)
        (source, system), (target, _) = self._system(staged), self._system(self._log(version))
        if system.exists(target) or not system.rename(source, target):
            raise RuntimeError(f"version {version} of {self.path} is taken by another writer")
        return BucketTable(self.spark, self.path)

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64, order: str | None = None) -> BucketTable:
        """A new table with df's rows, one per key (``last_of_key``). Fails where one is."""
        table = cls(df.sparkSession, path)
        if table.version >= 0:
            raise ValueError(f"{path} holds a table")
        table.schema, table.key, table.buckets = df.schema, key, buckets
        return table.merge(df, lambda old, new: last_of_key(new, key, order))

    # --- reading

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/data/{self.files[b]}/_b={b}" for b in buckets if b in self.files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(sorted(self.files))

    # --- changes

    def merge(self, source: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, writer: str = "default") -> BucketTable:
        """The next version: ``how`` gets the rows of the touched buckets and the source's, and returns all rows that those
        buckets hold from then on. A ``batch`` that is not above the writer's last changes nothing. A source row without
        a key is an error."""
        if batch is not None and batch <= self.batches.get(writer, -1):
            return self
        new = written(source, "bucket-source")
        touched = [r[0] for r in new.select(F.when(F.col(f"`{self.key}`").isNotNull(), self.bucket(F.col(f"`{self.key}`")))).distinct().collect()]  # at most ``buckets``
        if None in touched:
            raise ValueError(f"rows without {self.key}")
        batches = self.batches if batch is None else self.batches | {writer: batch}
        version = self.version + 1
        if not touched:
            return self._commit(version, "", [], [], batches) if batch is not None or version == 0 else self
        old = self._rows(touched)
        # a bucket of many rows is written by several tasks, so that no task's share grows with the table
        tasks = max(len(touched), -(-(old.count() + new.count()) // self.rows_per_task))
        deal = F.pmod(F.xxhash64(F.lit("task"), F.col(f"`{self.key}`")), F.lit(-(-tasks // len(touched))))
        rows = how(old, new).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        placed = rows.withColumn("_b", self.bucket(F.col(f"`{self.key}`"))).repartition(tasks, "_b", deal)
        part = f"{version:012d}-{uuid.uuid4().hex}"  # no other writer's
        placed.write.partitionBy("_b").parquet(f"{self.path}/data/{part}")
        at, system = self._system(f"{self.path}/data/{part}")
        made = [int(n[3:]) for n in (s.getPath().getName() for s in system.listStatus(at)) if n.startswith("_b=")]
        return self._commit(version, part, made, [b for b in touched if b not in made], batches)

    def upsert(self, source: DataFrame, as_of: dt.datetime | None = None, order: str | None = None, batch: int | None = None, writer: str = "default") -> BucketTable:
        """Source values win, columns that it lacks stay, new keys join; ``updated_at``, where there is one, becomes as_of."""
        return self.merge(source, lambda old, new: merge_upsert(old, new, self.key, as_of, order), batch, writer)

    def update(self, source: DataFrame, order: str | None = None, batch: int | None = None, writer: str = "default") -> BucketTable:
        """Partial update of known keys: null source values and other columns leave what is there; unknown keys are left out."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            one = last_of_key(new, self.key, order)
            given = [c for c in one.columns if c != self.key and c in old.columns]
            rows = old.join(one.select(F.col(f"`{self.key}`"), *[F.col(f"`{c}`").alias(f"_n_{c}") for c in given]), self.key, "left")
            return rows.select(*[F.coalesce(F.col(f"_n_{c}"), F.col(f"`{c}`")).alias(c) if c in given else F.col(f"`{c}`") for c in old.columns])

        return self.merge(source, how, batch, writer)

    def delete(self, keys: DataFrame, at: dt.datetime | None = None, column: str = "deleted_at", batch: int | None = None, writer: str = "default") -> BucketTable:
        """Rows of these keys go; with a time they stay and get that in ``column``, where they have none yet."""

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            if at is None:
                return old.join(new, self.key, "left_anti")
            rows = old.join(new.distinct().withColumn("_gone", F.lit(True)), self.key, "left")
            return rows.withColumn(column, F.when(F.col("_gone"), F.coalesce(F.col(column), F.lit(at))).otherwise(F.col(column))).drop("_gone")

        return self.merge(keys.select(self.key), how, batch, writer)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes log entries before the last ``keep`` versions, and the data that no entry names any more; returns what went
        of that."""
        entries = self._versions()
        for v in entries[:-keep]:
            at, system = self._system(self._log(v))
            system.delete(at, True)
        logs = [self._log(v) for v in entries[-keep:]]
        used = {r[0] for r in self.spark.read.schema(LOG).parquet(*logs).select("part").distinct().collect()} if logs else set()
        at, system = self._system(f"{self.path}/data")
        gone = [n for n in (s.getPath().getName() for s in system.listStatus(at)) if n not in used] if system.exists(at) else []
        for n in gone:
            path, _ = self._system(f"{self.path}/data/{n}")
            system.delete(path, True)
        return sorted(gone)


def stream_into(path: str, change: Callable[[BucketTable, DataFrame, int], BucketTable]) -> Callable[[DataFrame, int], None]:
    """A micro-batch handler: opens the table and applies the change with the batch's number, so that a batch that is handed over
    again after a restart counts once."""

    def handle(df: DataFrame, batch: int) -> None:
        change(BucketTable(df.sparkSession, path), df, batch)

    return handle
