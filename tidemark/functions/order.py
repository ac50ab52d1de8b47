"""Places and quantiles in the order of all rows, exact at any size: rows are dealt into ranges that sampled quantiles cut, and
what comes before a range is added, so that no task orders or holds all rows."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, *order: Column, name: str = "place", ranges: int = 64) -> DataFrame:
    """df with the place of each row in the whole order, from 0. The order must be total."""
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = dealt.groupBy("_range").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, inner.cast("long")).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], ranges: int = 64) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of columns over all rows (null where a column has no value), all columns in one pass.
    Values are counted first, so a value that many rows share is one row; the driver gets the sizes of the ranges and the
    values at the places that are asked for."""
    columns = list(wanted)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v").where("v is not null")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange(ranges, "feature", "v").withColumn("_range", F.spark_partition_id()), "quantiles")
    sizes: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    for r in dealt.groupBy("feature", "_range").agg(F.sum("n").alias("n")).orderBy("feature", "_range").collect():
        sizes[r.feature].append((r["_range"], r.n))
    places = []
    for c, qs in wanted.items():
        n = sum(x for _, x in sizes[c])
        for at in sorted({p for q in qs for p in (floor((n - 1) * q), min(n - 1, floor((n - 1) * q) + 1))} if n else ()):
            left = at
            for k, size in sizes[c]:
                if left < size:
                    places.append((c, k, left, at))
                    break
                left -= size
    found: dict[tuple[str, int], float] = {}
    if places:
        asked = df.sparkSession.createDataFrame(places, "feature string, _range int, offset long, at long")
        some = dealt.join(F.broadcast(asked.select("feature", "_range").distinct()), ["feature", "_range"], "left_semi")
        end = F.sum("n").over(Window.partitionBy("feature", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        rows = some.withColumn("_end", end).join(F.broadcast(asked), ["feature", "_range"]).where("offset < _end and offset >= _end - n")
        found = {(r.feature, r["at"]): r.v for r in rows.select("feature", "at", "v").collect()}
    out: dict[str, list[float | None]] = {}
    for c, qs in wanted.items():
        n = sum(x for _, x in sizes[c])
        out[c] = []
        for q in qs:
            low = floor((n - 1) * q) if n else 0
            a = found.get((c, low))
            out[c].append(None if a is None else a + ((n - 1) * q - low) * (found[c, min(n - 1, low + 1)] - a))
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], ranges: int = 64) -> DataFrame:
    """(keys, quantiles): linear-interpolated quantiles of the value within each group, in the order of ``qs``; nulls are left out,
    and so are groups without values. Values are counted first and dealt by (group, value) into ranges, so that a group of any
    size is many tasks' work."""
    group = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("g")
    counts = df.select(group, F.col(f"`{value}`").cast("double").alias("v")).where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange(ranges, "g", "v").withColumn("r", F.spark_partition_id()), "quantiles")
    sizes = dealt.groupBy("g", "r").agg(F.sum("n").alias("n"))  # of a group a row per range
    of_group = Window.partitionBy("g")
    sizes = sizes.withColumn("end", F.sum("n").over(of_group.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of_group))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("all") - 1) * q), F.least(F.floor((F.col("all") - 1) * q) + 1, F.col("all") - 1)) for q in qs])))
    asked = sizes.withColumn("place", F.explode(F.filter(places, lambda p: (p < F.col("end")) & (p >= F.col("end") - F.col("n"))))).select("g", "r", "all", "place", (F.col("place") - F.col("end") + F.col("n")).alias("offset"))
    within = dealt.join(asked.select("g", "r").distinct(), ["g", "r"], "left_semi").withColumn("upto", F.sum("n").over(Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    met = within.join(asked, ["g", "r"]).where("offset < upto and offset >= upto - n")
    found = met.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"), F.max("all").alias("all"))  # two places a quantile at most
    low = lambda q: F.floor((F.col("all") - 1) * q)
    one = lambda q: F.col("at")[low(q)] + ((F.col("all") - 1) * q - low(q)) * (F.col("at")[F.least(low(q) + 1, F.col("all") - 1)] - F.col("at")[low(q)])
    return found.select("g.*", F.array(*[one(q) for q in qs]).alias("quantiles"))


def neighbourhoods(df: DataFrame, order: list[Column], values: dict[str, Column], reach: int, block: int = 1_000_000) -> DataFrame:
    """df with averages (name: column) over the ``reach`` rows before and after each row in the whole order, which must be total. The order
    is cut in blocks (of ``reach`` rows at least), and the rows at their edges go to both sides."""
    if block < reach:
        raise ValueError("a block must hold the rows around one")
    placed = numbered(df, *order, name="_place")
    at = F.floor(F.col("_place") / block)
    copies = F.array_distinct(F.array(at, F.floor((F.col("_place") - reach) / block), F.floor((F.col("_place") + reach) / block)))
    w = Window.partitionBy("_block").orderBy("_place").rowsBetween(-reach, reach)
    rows = placed.withColumn("_block", F.explode(copies)).select("*", *[F.avg(c).over(w).alias(name) for name, c in values.items()])
    return rows.where(F.col("_block") == at).drop("_block", "_place")


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The commonest value of each column over all rows, the smallest of equals; null without values."""
    return {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("x")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"]).first()[0] for c in columns}
