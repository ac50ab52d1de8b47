"""Approximate vector search by a stored inverted file: vectors lie in the cell of their nearest coarse centre as one byte a
dimension of what the centre leaves over; a search looks into the cells nearest to a query and scores the best of
them anew on the original vectors.

Queries and cells are both cut in packs of bounded size, so that a cell that many vectors or queries share is many rows of
the join, and pairs exist only as a matrix within a task. Only the centres (``cells`` times dimensions numbers) and the
sizes of cells are known to every task. The vectors are a stored table by key, so that upserts and deletions write the
buckets that they touch, and a search sees them at once; centres stay until the index is built anew."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..sources.buckets import BucketTable
from ..sources.shared import written
from .similarity import knn, vector_similarity

MOST_CELLS = 1 << 16
PACK_ROWS, PACK_QUERIES = 4096, 256


def unit(vector: Column) -> Column:
    """The vector at length 1, as doubles; null for one that is null, zero or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class VectorIndex:
    """``build`` makes it, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        t = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres, self.scale, self.vector = np.array([r.centre for r in t]), t[0].scale, t[0].vector
        self.table = BucketTable(spark, f"{self.path}/vectors")
        self.key = self.table.key

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = 50_000, buckets: int = 64, seed: int = 42) -> VectorIndex:
        """An index of df's rows with all their columns. Cells (the root of the number of rows, if not given) are fitted on about
        ``sample`` rows, taken by a hash of the key; every usable vector is indexed. Vectors are of one length."""
        spark, known = df.sparkSession, df.withColumn("_u", unit(F.col(vector))).where("_u is not null")
        n = known.count()
        if not n:
            raise ValueError("no vectors")
        k = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
        share = min(1.0, sample / n)
        some = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select(array_to_vector("_u").alias("_v")).cache()
        centres = np.array(KMeans(k=max(2, k), seed=seed, maxIter=10, featuresCol="_v", predictionCol="_c").fit(some).clusterCenters()) if n > 2 else np.array(known.first()["_u"])[None, :]
        some.unpersist()
        scale = 1.0  # residuals of unit vectors are at most 2 long; nearly all of their components are under 1
        spark.createDataFrame([(i, [float(x) for x in c], scale, vector) for i, c in enumerate(centres)], "cell int, centre array<double>, scale double, vector string").coalesce(1).write.parquet(f"{path}/centres")
        shell = cls.__new__(cls)
        shell.spark, shell.path, shell.centres, shell.scale, shell.vector = spark, path.rstrip("/"), centres, scale, vector
        BucketTable.create(shell._coded(df), f"{shell.path}/vectors", key, buckets)
        return cls(spark, path)

    def _coded(self, df: DataFrame) -> DataFrame:
        """df with ``_cell`` and ``_code``; rows without a usable vector have neither and are found by no search."""
        centres, scale = self.centres, self.scale
        half = (centres * centres).sum(axis=1) / 2

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("_u")
                ok = np.asarray(u.is_valid())
                cell, codes = np.zeros(len(batch), np.int32), [None] * len(batch)
                if ok.any():
                    x = _rows(u.filter(pa.array(ok)))
                    at = (x @ centres.T - half).argmax(axis=1)
                    left = np.clip(np.rint((x - centres[at]) / scale * 127), -127, 127).astype(np.int8)
                    cell[ok] = at
                    for i, row in zip(np.flatnonzero(ok), left, strict=True):
                        codes[i] = row.tobytes()
                rest = batch.drop_columns(["_u"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cell, mask=~ok), pa.array(codes, pa.binary())], [*rest.schema.names, "_cell", "_code"])

        rows = df.withColumn("_u", unit(F.col(self.vector)))
        schema = StructType([*df.schema.fields, StructField("_cell", IntegerType()), StructField("_code", BinaryType())])
        return rows.mapInArrow(place, schema)

    # --- changes

    def upsert(self, df: DataFrame, batch: int | None = None) -> VectorIndex:
        """Rows of known keys are replaced, new ones join; the index's columns, of which df has all."""
        self.table = self.table.upsert(self._coded(df), batch=batch)
        return self

    def delete(self, keys: DataFrame, batch: int | None = None) -> VectorIndex:
        self.table = self.table.delete(keys, batch=batch)
        return self

    def cells(self) -> DataFrame:
        """(cell, vectors) of the cells that hold any."""
        return self.table.read().where("_cell is not null").groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("vectors"))

    # --- search

    def _packs(self, rows: DataFrame, by: str, columns: list[str], most: int) -> DataFrame:
        """Rows of (cell, ...) as lists of about ``most``; a cell has as many lists as its rows need."""
        size = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("_lists"))
        dealt = rows.join(F.broadcast(size), "cell").withColumn("_pack", F.pmod(F.xxhash64(by), F.col("_lists")))
        return dealt.groupBy("cell", "_pack").agg(*[F.collect_list(c).alias(f"{c}s") for c in columns]).drop("_pack")

    def search(self, queries: DataFrame, k: int, probes: int, rerank: int | None = None, where: str | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): of each query (key, vector) the k best by cosine that its ``probes`` nearest cells hold,
        itself excluded; ``rerank`` (10 k, if not given) of them, best by their codes, are scored on the original vectors.
        ``where`` filters the index by its other columns. With all cells probed only the codes' coarseness loses neighbours."""
        centres, scale, r, spread = self.centres, self.scale, rerank or 10 * k, min(probes, len(self.centres))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch.column("unit"))
                if not len(x):
                    continue
                far = x @ centres.T - (centres * centres).sum(axis=1) / 2
                at = np.argpartition(-far, spread - 1, axis=1)[:, :spread]
                take = pa.array(np.repeat(np.arange(len(x)), spread))
                yield pa.RecordBatch.from_arrays([batch.column("query").take(take), batch.column("unit").take(take), pa.array(at.ravel().astype(np.int32))], ["query", "unit", "cell"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    q, u, ids, codes = (batch.column(c)[i].values for c in ("querys", "units", "ids", "codes"))
                    q, ids, x = q.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), _rows(u)
                    left = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32) * (scale / 127)
                    y = left + centres[batch.column("cell")[i].as_py()].astype(np.float32)
                    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                    found = x.astype(np.float32) @ y.T
                    found[q[:, None] == ids[None, :]] = -np.inf
                    take = min(r, len(ids))
                    at = np.argpartition(-found, take - 1, axis=1)[:, :take]
                    s = np.take_along_axis(found, at, axis=1)
                    some = np.isfinite(s)
                    yield pa.RecordBatch.from_pydict({"query": np.repeat(q, some.sum(axis=1)), "id": ids[at][some], "near": s[some].astype(np.float64)})

        stored = self.table.read()
        stored = stored.where(where) if where else stored
        some = stored.where("_cell is not null")
        asked = queries.select(F.col(self.key).cast("long").alias("query"), F.col(self.vector).alias("_q"), unit(F.col(self.vector)).alias("unit")).where("unit is not null")
        looked = asked.select("query", "unit").mapInArrow(probe, "query long, unit array<double>, cell int")
        q = self._packs(looked, "query", ["query", "unit"], PACK_QUERIES)
        lists = self._packs(some.select(F.col("_cell").alias("cell"), F.col(self.key).cast("long").alias("id"), F.col("_code").alias("code")), "id", ["id", "code"], PACK_ROWS)
        met = q.join(lists, "cell").select("cell", "querys", "units", "ids", "codes").mapInArrow(score, "query long, id long, near double")
        first = met.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))).where(F.col("_n") <= r).select("query", "id")
        whole = first.join(some.select(F.col(self.key).cast("long").alias("id"), F.col(self.vector).alias("_vector")), "id").join(asked.select("query", "_q"), "query")
        exact = whole.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round(vector_similarity(F.col("_q"), F.col("_vector")), 9).alias("score"))
        best = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "vec_id", "score")

    def _sampled(self, k: int, queries: int) -> tuple[DataFrame, DataFrame]:
        """Stored vectors that a hash chooses, and their exact neighbours."""
        rows = self.table.read().where("_cell is not null").select(F.col(self.key).cast("long").alias("vec_id"), F.col(self.vector).alias("embedding"), "_cell")
        some = written(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries), "index-queries")
        return some, written(knn(some, rows, k).join(rows.select("vec_id", "_cell"), "vec_id"), "index-exact")

    def recall(self, k: int, probes: int, queries: int = 64) -> float:
        """Share of a search's results that are as near as the k exact neighbours, over ``queries`` stored vectors."""
        some, exact = self._sampled(k, queries)
        worst = exact.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        found = self.search(some.select(F.col("vec_id").alias(self.key), F.col("embedding").alias(self.vector)), k, probes)
        hits = found.join(worst, "query_id").where("score >= worst").count()
        n = worst.agg(F.sum("n")).first()[0]
        return hits / n if n else 1.0

    def probes_for(self, k: int, recall: float = 0.95, queries: int = 64) -> int:
        """How many cells must be probed until they hold that share of the exact neighbours of ``queries`` stored vectors."""
        some, exact = self._sampled(k, queries)
        pairs = exact.select("query_id", "_cell").join(some.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("u")), "query_id").collect()  # queries times k
        if not pairs:
            return 1
        far = np.array([r.u for r in pairs]) @ self.centres.T - (self.centres * self.centres).sum(axis=1) / 2
        place = (far > far[np.arange(len(pairs)), [r["_cell"] for r in pairs]][:, None]).sum(axis=1)
        return int(np.sort(place)[max(0, math.ceil(recall * len(pairs)) - 1)]) + 1
