"""Spectra of series of any length. Short series are transformed one by one within a task; a longer one is a convolution
with a chirp, whose transforms are tables of columns and rows of about the square root of its length, so that no task
holds a series (numpy sees one column or row at a time)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .order import numbered

_CELL = "series long, n long, i long, re double, im double"


def _chirp(i: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi * j * i * i / n); the square is reduced in whole numbers, which keeps the angle exact."""
    square = np.array([int(x) * int(x) % (2 * n) for x in i], np.float64) if n > 1 << 31 else (i.astype(np.uint64) ** 2 % np.uint64(2 * n)).astype(np.float64)
    return np.exp(-1j * np.pi * square / n)


def _sides(n: int) -> tuple[int, int]:
    """Rows and columns, powers of two, of a table that holds a series of n values and its mirror."""
    bits = max(2, (2 * n - 2).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def _lines(df: DataFrame, line: Column, step) -> DataFrame:
    """Each line of each table through ``step(n, line, places, values) -> places, values``; a line has at most twice the square root
    of four times the series' length."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        series, n, number = (int(k) for k in key)
        at, values = step(n, number, rows["i"].to_numpy(), rows["re"].to_numpy() + 1j * rows["im"].to_numpy())
        return pd.DataFrame({"series": series, "n": n, "i": at, "re": values.real, "im": values.imag})

    return df.withColumn("_line", line.cast("long")).groupBy("series", "n", "_line").applyInPandas(one, _CELL)


def _columns(inverse: bool):
    def step(n, column, at, values):
        rows, columns = _sides(n)
        whole = np.zeros(rows, complex)
        whole[at // columns] = values
        k = np.arange(rows)
        turned = (np.fft.ifft(whole) * rows if inverse else np.fft.fft(whole)) * np.exp((2j if inverse else -2j) * np.pi * (k * column % (rows * columns)) / (rows * columns))
        return k * columns + column, turned

    return step


def _rows(inverse: bool):
    """Place row + rows * column of the result is what row and column of the table hold."""

    def step(n, row, at, values):
        rows, columns = _sides(n)
        whole = np.zeros(columns, complex)
        whole[at % columns] = values
        k = np.arange(columns)
        return row + rows * k, np.fft.ifft(whole) * columns if inverse else np.fft.fft(whole)

    return step


def _width(n: Column) -> Column:
    """Columns of ``_sides``, as an expression."""
    bits = F.greatest(F.lit(2), F.length(F.bin(2 * n - 2)))
    return F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")


def _transformed(df: DataFrame, inverse: bool = False) -> DataFrame:
    width = _width(F.col("n"))
    half = written(_lines(df, F.col("i") % width, _columns(inverse)), "spectrum")
    return written(_lines(half, F.floor(F.col("i") / width), _rows(inverse)), "spectrum")


def _long_spectrum(df: DataFrame) -> DataFrame:
    """(series, n, i, size): magnitudes of the transforms of (series, n, i, x), places from 0, at least two values a series."""

    def chirped(batches):
        for rows in batches:
            values = np.empty(len(rows), complex)
            for n, at in rows.groupby("n").indices.items():
                values[at] = rows["x"].to_numpy()[at] * _chirp(rows["i"].to_numpy()[at], int(n))
            yield pd.DataFrame({"series": rows["series"], "n": rows["n"], "i": rows["i"], "re": values.real, "im": values.imag})

    def mirrored(batches):  # of each length once: the chirp's conjugate, to both sides of 0
        for rows in batches:
            values = np.empty(len(rows), complex)
            for n, at in rows.groupby("n").indices.items():
                values[at] = _chirp(rows["i"].to_numpy()[at], int(n)).conj()
            yield pd.DataFrame({"series": 0, "n": rows["n"], "i": rows["i"], "re": values.real, "im": values.imag})
            back = rows["i"].to_numpy() > 0
            size = np.array([np.prod(_sides(int(n)), dtype=np.int64) for n in rows["n"].to_numpy()[back]], np.int64)
            yield pd.DataFrame({"series": 0, "n": rows["n"].to_numpy()[back], "i": size - rows["i"].to_numpy()[back], "re": values.real[back], "im": values.imag[back]})

    series = _transformed(df.select("series", "n", "i", "x").mapInPandas(chirped, _CELL))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 65536)))
    places = df.select("n").distinct().select("n", spread.alias("b")).repartition("n", "b").select(
        "n", F.explode(F.sequence(F.col("b") * 65536, F.least(F.col("b") * 65536 + 65535, F.col("n") - 1))).alias("i"))
    chirps = _transformed(places.mapInPandas(mirrored, _CELL)).select("n", "i", F.col("re").alias("a"), F.col("im").alias("b"))
    product = series.join(chirps, ["n", "i"]).select("series", "n", "i", (F.col("re") * F.col("a") - F.col("im") * F.col("b")).alias("re"), (F.col("re") * F.col("b") + F.col("im") * F.col("a")).alias("im"))
    cells = F.pow(F.lit(2.0), F.greatest(F.lit(2), F.length(F.bin(2 * F.col("n") - 2))))
    back = _transformed(product, inverse=True).where("i < n")
    return back.select("series", "n", "i", (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / cells).alias("size"))


def _peaks(size: np.ndarray, floor: float) -> int:
    """Values above both sides and not below the floor, ends left out; equal neighbours count as one."""
    if len(size) < 3:
        return 0
    one = size[np.concatenate(([True], size[1:] != size[:-1]))]
    return int(((one[1:-1] > one[:-2]) & (one[1:-1] > one[2:]) & (one[1:-1] >= floor)).sum())


def spectral_peaks(df: DataFrame, key: str, value: str, *order: str, share: float = 0.3, whole: int = 65_536, block: int = 1_000_000) -> DataFrame:
    """(key, n, peaks): values of each key's series, in a total order, and how many peaks the magnitudes of its Fourier transform
    have from the second to the one before the half, of at least ``share`` of the mean magnitude. Nulls are left out; a null key is
    a key; a key without values has no row. Magnitudes count to 9 digits of their mean. Series of more than ``whole`` values are
    transformed in parts and their peaks counted in blocks, with the same result."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("k"), F.col(value).cast("double").alias("x"), *order)
    placed = numbered(rows, F.col("k"), *[F.col(c) for c in order], name="place").select("k", "x", "place")
    ends = placed.groupBy("k").agg(F.min("place").alias("series"), F.count("*").alias("n"))  # a key's series is named by its first place
    placed = written(placed.join(ends, "k").select("k", "series", "n", (F.col("place") - F.col("series")).alias("i"), "x"), "series")
    short, long = placed.where(F.col("n") <= whole), placed.where(F.col("n") > whole)

    def of_one(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        size = np.abs(np.fft.fft(rows.sort_values("i")["x"].to_numpy()))
        size = np.round(size / size.mean(), 9) if size.any() else size
        return pd.DataFrame({"series": [int(key[0])], "n": [n], "peaks": [_peaks(size[1 : n // 2], share)]})

    out = "series long, n long, peaks long"
    found = short.groupBy("series").applyInPandas(of_one, out)
    if not long.isEmpty():
        sizes = _long_spectrum(long)
        mean = sizes.groupBy("series").agg(F.avg("size").alias("mean"))
        part = written(sizes.join(mean, "series").select("series", "n", "i", F.when(F.col("mean") > 0, F.round(F.col("size") / F.col("mean"), 9)).otherwise(0.0).alias("size")).where("i >= 1 and i < n div 2"), "spectrum")
        # a peak is where a rise is followed by a fall, with equal steps between; a block hands its last step on
        at = F.floor(F.col("i") / block)
        edge = part.withColumn("_b", F.explode(F.array_distinct(F.array(at, F.floor((F.col("i") - 1) / block)))))
        own = Window.partitionBy("series", "_b").orderBy("i")
        steps = edge.withColumn("step", F.signum(F.lead("size").over(own) - F.col("size"))).where((at == F.col("_b")) & F.col("step").isNotNull() & (F.col("step") != 0))
        steps = written(steps.select("series", "n", "_b", "i", "size", "step"), "steps")
        last = steps.groupBy("series", "_b").agg(F.max_by("step", "i").alias("step"))
        carried = last.select("series", "_b", F.lag("step").over(Window.partitionBy("series").orderBy("_b")).alias("carried"))  # a row per block
        before = F.coalesce(F.lag("step").over(own), F.col("carried"))
        peak = (F.col("step") < 0) & (before > 0) & (F.col("size") >= share)
        counted = steps.join(carried, ["series", "_b"]).select("series", peak.cast("long").alias("p")).groupBy("series").agg(F.sum(F.coalesce("p", F.lit(0))).alias("peaks"))
        found = found.unionByName(ends.where(F.col("n") > whole).select("series", "n").join(counted, "series", "left").select("series", "n", F.coalesce("peaks", F.lit(0)).cast("long").alias("peaks")))
    return ends.select("k", "series").join(found, "series").select(F.col("k.k").alias(key), "n", "peaks")
