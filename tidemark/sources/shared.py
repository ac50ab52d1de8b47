"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in a local session (tests) a temporary folder, which is then set, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StateLog:
    """Numbered small texts in a folder, as a handler's state after each batch: an entry is there whole or not at all, and one
    that is there is never replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _system(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, str] | None:
        """The largest number and its text, or None."""
        at, system = self._system(self.path)
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        numbers = [int(n) for n in names if n.isdigit()]
        return (max(numbers), self.spark.read.schema("entry string").parquet(f"{self.path}/{max(numbers):012d}").first()[0]) if numbers else None

    def put(self, number: int, entry: str, keep: int = 10) -> None:
        """Adds an entry, and deletes those before the last ``keep``. Fails where the number is taken."""
        staged = f"{self.path}/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(entry,)], "entry string").coalesce(1).write.parquet(staged)
        (source, system), (target, _) = self._system(staged), self._system(f"{self.path}/{number:012d}")
        if system.exists(target) or not system.rename(source, target):
            raise RuntimeError(f"entry {number} of {self.path} is taken")
        old = sorted(int(n) for n in (s.getPath().getName() for s in system.listStatus(self._system(self.path)[0])) if n.isdigit())[:-keep]
        for n in old:
            system.delete(self._system(f"{self.path}/{n:012d}")[0], True)
