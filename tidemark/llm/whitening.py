"""Embedding whitening over distinct vectors: equal rounded vectors are one row with their number of copies, means and
covariances are sums over those rows (each with the weight one, or that of its copies), every distinct vector is
projected once, and a join brings the result back to the rows.

Tasks hold a batch of vectors and one matrix of dimensions squared; the driver gets sums per dimension and one such
matrix per vector length. Nothing grows with the rows.

Defined cases: a vector that is null or holds null or non-finite entries takes no part and gives no row; vectors of
different lengths are whitened apart, each length over its own list, and an empty vector has no components, so that the
query has no row of it; repeated and null ids are rows of their own; entries whose rounded value passes 2**40 in
magnitude are held at that; a component whose eigenvalue is zero to double precision has a null ``whitened`` and counts
in no error; a single distinct vector has ``explained`` null; a deviation beyond a 64-bit integer is null; no rows give no
rows. Other columns, whatever their names, are kept only if ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_MOST = 1 << 40
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite entries."""
    big = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < big), F.lit(False))), F.lit(False))


def rounded(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of each entry, held within 2**40."""
    low, high = F.lit(-float(_MOST)), F.lit(float(_MOST))
    return F.transform(vector, lambda c: F.floor(F.greatest(low, F.least(high, c.cast("double") * scale))).cast("long") + F.lit(shift).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("d").to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        yield int(d), batch.filter(pa.array(lengths == d)) if (lengths != d).any() else batch


def _weights(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    return batch.column("copies").to_numpy(zero_copy_only=False) if counted else np.ones(len(batch), np.int64)


def _sums(distinct: DataFrame, counted: bool) -> dict[int, tuple[int, list[int]]]:
    """Of each vector length: total weight and exact weighted sums per dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, some in _by_length(batch, "x"):
                w, x = _weights(some, counted), _matrix(some.column("x"))
                if int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62:
                    s = [int(v) for v in w @ x]
                else:
                    s = [sum(map(int.__mul__, map(int, w), map(int, x[:, j]))) for j in range(d)]
                yield pa.RecordBatch.from_pydict({"d": pa.array([d] * (d + 1), pa.int32()), "i": pa.array(range(-1, d), pa.int32()), "s": [str(v) for v in [int(w.sum()), *s]]})

    cells = distinct.select("d", "x", "copies").mapInArrow(partial, "d int, i int, s string")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "i").collect():
        if r.i < 0:
            out[r.d] = (int(r.s), [])
        else:
            out[r.d][1].append(int(r.s))
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact integer n * x - S wherever that fits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < _LONG:
        return (n * x - np.array(sums, np.int64)) / n
    return ((n * x.astype(object) - np.array(sums, object)) / n).astype(np.float64)


def _covariances(df: DataFrame, column: str, centre: dict, counted: bool) -> dict[int, np.ndarray]:
    """Of each vector length the weighted covariance of a list column: one centred matrix product per batch, one matrix
    per task, added by cells."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, some in _by_length(batch, column):
                y = centre[d](_matrix(some.column(column)))
                gram[d] = gram.get(d, 0.0) + (y * _weights(some, counted)[:, None]).T @ y
        for d, g in gram.items():
            for i, row in enumerate(g):
                yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(row), pa.int32()), "i": pa.array([i] * len(row), pa.int32()), "j": pa.array(range(len(row)), pa.int32()), "v": row})

    cells = df.select("d", column, "copies").mapInArrow(partial, "d int, i int, j int, v double")
    out: dict[int, dict] = {}
    for r in cells.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.d, {})[r.i, r.j] = r.v
    found = {}
    for d, cell in out.items():
        size = 1 + max(i for i, _ in cell)
        found[d] = np.array([[cell[i, j] for j in range(size)] for i in range(size)])
    return found


@dataclass
class Fit:
    """What one vector length was fitted to: weight, sums, projection (dimensions x components, null ones as NaN), shares."""

    n: int
    sums: list[int]
    project: np.ndarray
    explained: list[float | None]


def _fitted(n: int, sums: list[int], covariance: np.ndarray, most: int) -> Fit:
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2 / n)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(values.sum())
    sound = values[order] > max(float(values.max(initial=0)), 0.0) * len(values) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        project = np.where(sound, vectors[:, order] / np.sqrt(values[order]), np.nan)
    return Fit(n, sums, project, [max(0.0, float(v)) / trace if trace > 0 else None for v in values[order]])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S)**2, in 64 bits where they fit and in Python's integers beyond."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < _LONG:
        apart = n * x - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < _LONG:
            return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, object)
    return [v if v <= _LONG else None for v in (apart * apart).sum(axis=1).tolist()]


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most: int = 16, weights: str = "one",
           scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """A row per row of df with a usable vector: the kept columns, copies (rows of the same rounded vector), n (total weight
    of the fit list), deviation (sum of (n * x - S)**2), whitened (at most ``most`` values, by falling eigenvalue), explained
    (their shares of the variance) and identity_error (how far the covariance of whitened is from the identity).

    ``weights`` is ``one`` (a distinct vector counts once) or ``count`` (as often as it occurs)."""
    if weights not in ("one", "count"):
        raise ValueError(f"weights {weights!r}")
    counted = weights == "count"
    rows = df.where(usable(F.col(vector))).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), rounded(F.col(vector), scale, shift).alias("x"))
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("d", F.size("x")), "distinct-vectors")
    sums = {d: s for d, s in _sums(distinct, counted).items()}
    centres = {d: (lambda x, n=n, s=s: _centred(x, n, s)) for d, (n, s) in sums.items()}
    covariances = _covariances(distinct.where("d > 0"), "x", centres, counted)
    fits = {d: _fitted(n, s, covariances[d] if d else np.zeros((0, 0)), most) for d, (n, s) in sums.items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, some in _by_length(batch, "x"):
                fit, x = fits[d], _matrix(some.column("x")) if d else np.zeros((len(some), 0), np.int64)
                y = _centred(x, fit.n, fit.sums) @ fit.project
                k = y.shape[1]
                flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel()))
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_pydict({"x": some.column("x"), "copies": some.column("copies"), "d": some.column("d"), "deviation": pa.array(_deviations(x, fit.n, fit.sums), pa.int64()), "whitened": whitened})

    flat = written(distinct.mapInArrow(project, "x array<long>, copies long, d int, deviation long, whitened array<double>"), "whitened")
    errors = _identity_errors(flat, fits, counted)
    of = [(d, f.n, f.explained, errors.get(d)) for d, f in fits.items()]
    known = df.sparkSession.createDataFrame(of, "d int, n long, explained array<double>, identity_error double")
    back = rows.join(flat, "x").join(F.broadcast(known), "d")  # a row for each vector length
    return back.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], "copies", "n", "deviation", "whitened", "explained", "identity_error")


def _identity_errors(flat: DataFrame, fits: dict[int, Fit], counted: bool) -> dict[int, float]:
    """Of each vector length the largest entry of the whitened rows' covariance less the identity, over the sound components
    alone. The mean that centres them is measured too."""
    sound = {d: np.flatnonzero(~np.isnan(f.project).any(axis=0)) for d, f in fits.items()}
    part = flat.where(F.size("whitened") > 0)
    w = F.col("copies") if counted else F.lit(1)
    means: dict[int, np.ndarray] = {}
    for r in part.select("d", w.alias("w"), F.posexplode("whitened").alias("i", "v")).groupBy("d", "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).collect():
        means.setdefault(r.d, np.zeros(fits[r.d].project.shape[1]))[r.i] = r.m or 0.0
    keep = {d: (lambda y, d=d: np.asarray(y, np.float64)[:, sound[d]] - means[d][sound[d]]) for d in means if len(sound[d])}
    found = _covariances(part.where(F.col("d").isin(list(keep))), "whitened", keep, counted) if keep else {}
    return {d: float(np.abs(c / fits[d].n - np.eye(len(c))).max()) for d, c in found.items()}
