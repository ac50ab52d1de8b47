"""Hooks for a caller's own functions, and maps and digests as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_partitions(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over Arrow batches of each partition as pandas frames; a batch is bounded, whatever the partition."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(each, schema)


def map_files(spark, path: str, f: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """f over (path, content) of each file, one file at a time in a task; for formats that Spark doesn't read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from pa.Table.from_pandas(f(name.as_py(), content.as_py()), preserve_index=False).to_batches()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, schema)


class FeatureRegistry:
    """Named features as columns over a frame, with the names that they need; asked for by name, with all that they
    depend on, in one pass."""

    def __init__(self):
        self.features: dict[str, tuple[Column, tuple[str, ...]]] = {}

    def register(self, name: str, column: Column, needs: tuple[str, ...] = ()) -> None:
        if name in self.features:
            raise ValueError(f"feature {name!r} is registered")
        self.features[name] = (column, needs)

    def compute(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the features. Raises for unknown names and for circles."""
        order: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"circle at {name!r}")
            if name not in order and name in self.features:
                for n in self.features[name][1]:
                    visit(n, (*above, name))
                order.append(name)
            elif name not in self.features and name not in df.columns:
                raise ValueError(f"unknown feature {name!r}")

        for n in names:
            visit(n, ())
        for n in order:
            df = df.withColumn(n, self.features[n][0])
        return df


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both maps; where a key is in both, b's value. Null maps are empty."""
    empty = F.expr("map()").cast("map<string,string>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def digest(c: Column, kind: str = "sha256") -> Column:
    """Hexadecimal md5, sha1 or sha256, or crc32 as a number, of a string."""
    if kind == "crc32":
        return F.crc32(c)
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[kind](c)
