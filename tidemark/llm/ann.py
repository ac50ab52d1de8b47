"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled to the unit sphere of one more dimension, where the largest inner product is the nearest point.
A table hashes a point by M Gaussian projections cut in cells of width w: floor(a x / w). A query visits the cells of
each table in the order of estimated success, the chance that a neighbour's projections fall there given those of the
query, until the cells visited hold a calibrated share of that chance. Candidates of all tables are merged, and their
exact products rank them.

The share is calibrated on a bounded sample (``sample`` queries with their exact neighbours, found in one linear
pass), so that the sample's recall is ``recall``; every row is indexed. Up to ``exact_rows`` rows all cells are visited.

Of equal vectors only the k + 1 smallest ids can be among anyone's nearest k (ties go to smaller ids), so only these
are indexed: a vector that a third of all rows hold costs no more than others. Cells are split into blocks of
``block`` vectors, and a task holds one block at a time and the best k of the queries that it has met. Products with
``pivots`` vectors bound each query's k-th best from below, so that a task passes on only what may still count.

Defined cases: vectors that are null, zero, or that hold a null or non-finite component take no part; vectors of each
length are searched among themselves; a query's own vec_id is no candidate; queries that repeat an id and vector count once, and with one id
and several vectors the best products count; fewer than k candidates give fewer rows; no query or no vector gives no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FOUND = "query_id long, vec_id long, score double"
_erf = np.vectorize(erf, otypes=[float])


def usable(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, before their lengths are compared."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


@dataclass
class Hashes:
    """``tables`` tables of M projections each."""

    projections: np.ndarray  # tables x M x (dimension + 1)
    width: float
    longest: float

    @classmethod
    def draw(cls, dimension: int, tables: int, functions: int, width: float, longest: float, seed: int) -> Hashes:
        return cls(np.random.default_rng(seed).standard_normal((tables, functions, dimension + 1)), width, longest)

    def points(self, v: np.ndarray) -> np.ndarray:
        """Vectors on the sphere of one more dimension."""
        v = v / self.longest
        return np.hstack([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))[:, None]])

    def projected(self, v: np.ndarray, query: bool) -> np.ndarray:
        """rows x tables x M. A query lies on the sphere with last component 0."""
        p = np.hstack([v / np.linalg.norm(v, axis=1)[:, None], np.zeros((len(v), 1))]) if query else self.points(v)
        return np.einsum("nd,tmd->ntm", p, self.projections)

    def cells(self, v: np.ndarray) -> np.ndarray:
        """rows x tables: cell numbers, from M coordinates cut to -4 .. 3."""
        c = np.clip(np.floor(self.projected(v, False) / self.width), -4, 3).astype(np.int64) + 4
        return (c << (3 * np.arange(c.shape[2]))).sum(axis=2)


@dataclass
class Probes:
    """Which cells a query visits."""

    hashes: Hashes
    cells: list[np.ndarray]  # of each table, those that hold vectors
    sizes: list[np.ndarray]
    cosine: float
    share: float
    least: int

    def success(self, queries: np.ndarray, table: int) -> np.ndarray:
        """queries x cells: estimated chance that a neighbour lies in a cell, as shares of 1."""
        f = self.hashes.projected(queries, True)[:, table, :]
        norm = np.linalg.norm(self.hashes.projections[table], axis=1) / sqrt(self.hashes.projections.shape[2])
        spread = sqrt(max(1e-6, 1.0 - self.cosine**2)) * norm
        edges = np.concatenate(([-np.inf], np.arange(-3, 4) * self.hashes.width, [np.inf]))
        below = 0.5 * (1 + _erf((edges[None, None, :] - self.cosine * f[:, :, None]) / (spread[None, :, None] * sqrt(2))))
        each = np.log(np.maximum(np.diff(below, axis=2), 1e-12))  # queries x M x 8
        total = np.zeros((len(queries), len(self.cells[table])))
        for m in range(f.shape[1]):
            total += each[:, m, (self.cells[table] >> (3 * m)) & 7]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def visited(self, queries: np.ndarray, table: int) -> np.ndarray:
        """queries x cells: whether a cell is among the first by success that make up the share and hold enough rows."""
        p = self.success(queries, table)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
        held = np.cumsum(self.sizes[table][order], axis=1) - self.sizes[table][order]
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, (before < self.share) | (held < self.least), 1)
        return out


def _slack(v: np.ndarray, longest: float) -> np.ndarray:
    """By how much products of each row with a vector may differ between orders of summation, and more."""
    return 1e-14 * v.shape[1] * np.linalg.norm(v, axis=1) * longest


class _Best:
    """The best k (score, id) of each query so far; ties go to smaller ids."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray | None = None) -> None:
        """q, x: vectors of the queries and of ids; products under ``least`` of a query are left out. The matrix product
        says which may count; their scores are sums in the order of the components."""
        scores = q @ x.T
        scores[queries[:, None] == ids[None, :]] = -np.inf
        k = min(self.k, scores.shape[1])
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        floor = (floor if least is None else np.maximum(floor, least)) - _slack(q, float(np.linalg.norm(x, axis=1).max()))
        for who, own, row, low in zip(queries.tolist(), q, scores, floor, strict=True):
            at = np.flatnonzero((row >= low) & (row > -np.inf))
            if not at.size:
                continue
            s, i = np.cumsum(x[at] * own, axis=1)[:, -1], ids[at]
            if who in self.of:
                s, i = np.concatenate((self.of[who][0], s)), np.concatenate((self.of[who][1], i))
                i, first = np.unique(i, return_index=True)
                s = s[first]
            order = np.lexsort((i, -s))[: self.k]
            self.of[who] = (s[order], i[order])

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(np.fromiter(self.of, np.int64, len(self.of)), [len(x[0]) for x in self.of.values()] if self.of else [])
        i = np.concatenate([x[1] for x in self.of.values()]) if self.of else np.empty(0, np.int64)
        s = np.concatenate([x[0] for x in self.of.values()]) if self.of else np.empty(0)
        self.of = {}
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(index: DataFrame, queries: list, k: int) -> DataFrame:
    """A bounded list of query rows (vec_id, v) against all rows of index, in one pass."""
    ids, q = np.array([r.vec_id for r in queries], np.int64), np.array([r.v for r in queries])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            if batch.num_rows:
                best.add(ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield best.rows()

    return _ranked(index.select("vec_id", "v").mapInArrow(each, FOUND), k)


def _packed(v: np.ndarray) -> bytes:
    """Vectors as bytes, in single precision where that is exact; the first byte says which."""
    small = v.astype(np.float32)
    return b"f" + small.tobytes() if (small == v).all() else b"d" + v.tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).reshape(rows, -1).astype(np.float64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 4, functions: int = 6, width: float = 2.0,
           recall: float = 0.95, sample: int = 64, pivots: int = 1024, block: int = 4096, seed: int = 11,
           vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k vectors of largest inner product that were found."""
    every, asked = usable(vectors, vec, embedding), usable(queries, vec, embedding).distinct()
    # vectors of different lengths have no product: each length is a search of its own
    lengths = sorted(r[0] for r in every.select(F.size("v")).distinct().collect())
    found = [_search(*(x.where(F.size("v") == d) for x in (every, asked)), d, k, tables, functions, width, recall, sample, pivots, block, seed) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(every: DataFrame, asked: DataFrame, dimension: int, k: int, tables: int, functions: int, width: float, recall: float,
            sample: int, pivots: int, block: int, seed: int) -> DataFrame:
    spark = every.sparkSession
    few = Window.partitionBy("v").orderBy("vec_id")
    index = written(every.distinct().withColumn("copy", F.row_number().over(few)).where(F.col("copy") <= k + 1).select("vec_id", "v"), "ann-rows")
    about = index.agg(F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")).alias("longest")).first()

    hashes = Hashes.draw(dimension, tables, functions, width, about.longest * (1 + 1e-12), seed)
    sent = spark.sparkContext.broadcast(hashes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = sent.value.cells(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(c.shape[1], dtype=np.int32), len(c))), pa.array(c.ravel())], ["t", "cell"])

    held = index.mapInArrow(hashed, "t int, cell long").groupBy("t", "cell").count().collect()  # at most tables x cells rows
    cells = [np.array([r.cell for r in held if r.t == t], np.int64) for t in range(tables)]
    sizes = [np.array([r["count"] for r in held if r.t == t], np.int64) for t in range(tables)]
    probes = _calibrated(Probes(hashes, cells, sizes, 0.0, 2.0, 8 * k), index, asked, k, recall, sample)
    sent_probes = spark.sparkContext.broadcast(probes)
    sent_splits = spark.sparkContext.broadcast({(r.t, r.cell): -(-r["count"] // block) for r in held})
    # a bounded set of vectors whose products bound each query's k-th best from below: what is under it isn't passed on
    some = index.orderBy(F.xxhash64(F.lit("pivots"), "vec_id"), "vec_id", "v").limit(pivots).collect()
    sent_pivots = spark.sparkContext.broadcast((np.array([r.vec_id for r in some], np.int64), np.array([r.v for r in some]).reshape(len(some), dimension)))

    names = ["t", "cell", "part", "asks", "ids", "least", "v"]
    schema = "t int, cell long, part int, asks boolean, ids binary, least binary, v binary"

    def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of one table, cell and block as one row per batch."""
        for batch in batches:
            i, v, rows = batch.column(0).to_numpy(), _matrix(batch.column(1)), []
            for t, own in enumerate(sent.value.cells(v).T if len(i) else ()):
                split = np.array([sent_splits.value[t, c] for c in own.tolist()])
                part = (i * 0x9E3779B1 >> 16) % split
                order = np.lexsort((part, own))
                edge = np.flatnonzero(np.diff(own[order]) | np.diff(part[order])) + 1
                for at in np.split(order, edge):
                    rows.append((t, own[at[0]], part[at[0]], False, i[at].tobytes(), b"", _packed(v[at])))
            yield packed_rows(rows)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a batch that visit a cell as one row for each of its blocks."""
        pivot_ids, pivot = sent_pivots.value
        for batch in batches:
            i, v, rows = batch.column(0).to_numpy(), _matrix(batch.column(1)), []
            least = np.full(len(i), -np.inf)
            if len(pivot_ids) > k and len(i):
                scores = v @ pivot.T
                scores[i[:, None] == pivot_ids[None, :]] = -np.inf
                least = np.partition(scores, len(pivot_ids) - k, axis=1)[:, len(pivot_ids) - k]
            for t in range(tables if len(i) else 0):
                most = max(1, (1 << 22) // max(1, len(sent_probes.value.cells[t])))  # queries that are held against the cells at once
                visits = [sent_probes.value.visited(v[x : x + most], t) for x in range(0, len(i), most)]
                for c, who in zip(sent_probes.value.cells[t].tolist(), np.concatenate(visits).T, strict=True):
                    if (at := np.flatnonzero(who)).size:
                        row = (i[at].tobytes(), least[at].tobytes(), _packed(v[at]))
                        rows += [(t, c, p, True, *row) for p in range(sent_splits.value[t, c])]
                if len(rows) > 10_000:
                    yield packed_rows(rows)
                    rows = []
            yield packed_rows(rows)

    def of_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _Best(k)
            if batch.num_rows and len(sent_pivots.value[0]):
                best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)), *sent_pivots.value)
            yield best.rows()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, ids, rows, parts = _Best(k), None, None, None, []
        for batch in batches:
            for t, c, p, asks, i, least, v in zip(*(batch.column(x).to_pylist() for x in range(7)), strict=True):
                if now != (t, c, p):
                    now, parts, rows = (t, c, p), [], None
                i = np.frombuffer(i, np.int64)
                if not asks:
                    parts.append((i, _unpacked(v, len(i))))
                elif parts:
                    if rows is None:
                        ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                    v, least = _unpacked(v, len(i)), np.frombuffer(least, np.float64)
                    for x in range(0, len(i), 512):
                        best.add(i[x : x + 512], v[x : x + 512], ids, rows, least[x : x + 512])
            if len(best.of) > 50_000:
                yield best.rows()
        yield best.rows()

    batched = asked.repartition(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)))
    meeting = index.mapInArrow(placed, schema).unionByName(batched.mapInArrow(asking, schema))
    meeting = meeting.repartition("t", "cell", "part").sortWithinPartitions("t", "cell", "part", "asks")
    return _ranked(meeting.mapInArrow(met, FOUND).unionByName(asked.mapInArrow(of_pivots, FOUND)), k)


def _calibrated(probes: Probes, index: DataFrame, asked: DataFrame, k: int, recall: float, sample: int) -> Probes:
    """The cosine of the sample's k-th neighbours, and the least share by which the sample finds ``recall`` of them."""
    some = asked.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "v").limit(sample).collect()
    if not some:
        return probes
    near = exact(index, some, k).select("query_id", "vec_id").join(index, "vec_id").select("query_id", "v").collect()
    if not near:
        return probes
    h = probes.hashes
    vector = {r.vec_id: np.array(r.v) for r in some}
    q, x = np.array([vector[r.query_id] for r in near]), np.array([r.v for r in near])
    cosine = float(np.mean((q / np.linalg.norm(q, axis=1)[:, None] * x / h.longest).sum(axis=1)))
    probes = Probes(h, probes.cells, probes.sizes, min(0.999, max(0.0, cosine)), 1.0, probes.least)
    first = np.full(len(near), np.inf)  # the share at which some table visits the neighbour's cell
    own = h.cells(x)
    for t in range(len(probes.cells)):
        p = probes.success(q, t)
        at = np.argmax(probes.cells[t][None, :] == own[:, t][:, None], axis=1)
        mine = p[np.arange(len(p)), at][:, None]
        before = np.where(p > mine, p, 0.0).sum(axis=1)
        first = np.minimum(first, before)
    probes.share = float(np.quantile(first, recall)) + 1e-9
    return probes
