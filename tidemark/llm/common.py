"""Shared folder, tables and the rolling byte hash that the operators of this package use."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and is stripped from lines: \x20 and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in a local session, as in tests, is a
    temporary one made and set where it is unset; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it differ from all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


#: Spark's switch to drop the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_WRITING: dict[int, list] = {}  # of each session: how many writes run, and the setting before the first
_LOCK = threading.Lock()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP while at least one write of the session runs, also where several threads write."""
    with _LOCK:
        state = _WRITING.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, state[1]) if state[1] is not None else spark.conf.unset(CLEANUP)


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of any executor. The shuffle
    files that made it go at once, since nothing reads them after the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row that is the same in every scan, so that repeated ids stay separate rows. Rows of files, with
    any columns and filters, get the file's place among the sorted paths and their place in the file, whatever tasks read
    them; other rows (as of a join) are numbered and written once."""
    try:
        paths = df.select(F.col("_metadata.file_path").alias("_path"))
        placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = sorted(r[0] for r in paths.distinct().collect())
    known = df.sparkSession.createDataFrame(pa.table({"_path": pa.array(files, pa.string()), "_file": pa.array(range(len(files)), pa.int64())}))
    row = F.shiftleft("_file", 36) + F.col("_at")
    return placed.join(F.broadcast(known), "_path").select(*[F.col(f"`{c}`") for c in df.columns], row.alias(name))


# --- numpy helpers that run inside tasks -------------------------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit. Works on a copy."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, np.int8)
_IS_WHITE[list(WHITE)] = 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 2 * n)
        for key, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


class RollingHash:
    """64-bit hashes of any substrings of one byte array, from one cumulative sum (polynomial, modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of this width."""
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of runs of 64-bit values, from one cumulative sum; another salt gives another hash."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def text_groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes together, or one longer text: number of the first, bytes, and offsets of
    the texts in them (one more than there are texts). A null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, places, body = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of the first word of each text (and all)."""
    black = np.concatenate(([False], _IS_WHITE[data] == 0, [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(black[1:-1] & (edge[:-1] | ~black[:-2]))
    ends = np.flatnonzero(black[1:-1] & (edge[1:] | ~black[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def mixed_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; of all of them, if there are fewer."""
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return h


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``width`` words, A-Z lower-cased; with fewer words the whole
    sequence is one, with none the set is empty."""
    for _, data, offsets in text_groups(column):
        data = _LOWER[data]
        starts, ends, first = word_places(data, offsets)
        words = RollingHash(data).at(starts, ends)
        runs = mixed_shingles(words, width) if len(words) >= width else words
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            yield np.unique(runs[a : b - width + 1]) if b - a >= width else mixed_shingles(words[a:b], width) if b > a else words[:0]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), width))
