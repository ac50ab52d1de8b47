"""Suffix dedup by bucket-pointer refinement over a sparse set of suffixes. Every byte that a string of ``length``
bytes covers which also starts anywhere else goes.

The initial bucket of a suffix is its gram of ``gram`` bytes. A bucket of w bytes is refined to up to 2 w by the
identifiers of its suffix at its own and at a later offset, both of w bytes, and the refined identifiers are used again
for the next width (32, 64, 128, 200 bytes). So the identifier of any string comes from those of its halves, down to grams.

Suffixes are sampled where the text decides: of each window of ``length`` bytes, the place whose gram hashes lowest (its
anchor). Equal windows have equal anchors at equal distances, so the buckets of equal anchor grams hold all repeats. They
are sorted and refined in rounds, each over what the last one left open:

1. An item is an anchor with the windows that have it. Its bucket is its gram (which all of its windows share), its class
   the identifiers at the first and the last of its windows, which together are all the text that they cover.
2. A bucket of one item has no repeat. A class of several repeats in all its windows. A bucket of several classes is
   refined again, each class by the members of one row only: its items are split in blocks of 16 windows, whose buckets
   are the identifiers of the longer text that these windows share.
3. What is still mixed is split into single windows, whose identifiers decide.

Each decision is used again by the next round, so that text is refined to single places only next to where copies part.
Identifiers have 64 bits. Two different texts count as equal only if bucket and class collide both (in the last round the
identifiers of the first 128 bytes and of all 200), which is once in 2**128 pairs. Buckets that many rows share are
counted before they are shuffled, and classes are settled as rows of their own.

Defined cases: null text is empty; texts shorter than ``length`` keep all; rows that repeat an id, or have none, are
texts of their own (so equal ones repeat); other columns are ignored, whatever their names. docs must read the same rows
each time (a table).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, mix64, release, with_row_id, written

BLOCK = 16
ITEM = "core long, full long, _row long, anchor int, lo int, n int"
_NAMES = [x.split()[0] for x in ITEM.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def anchors(rolling: RollingHash, windows: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor (the leftmost lowest of 40-bit gram hashes), and all gram hashes."""
    width = length - gram + 1
    step = (1 << 24) - width
    found = []
    grams = rolling.every(gram)
    for at in range(0, windows, step):  # places within a part have 24 bits
        part = grams[at : min(at + step, windows) + width - 1]
        low = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        found.append((low & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    return np.concatenate(found), grams


def refined(grams: np.ndarray, at: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Identifiers of the strings of ``width`` bytes from these places: of two shorter ones, the second at a later offset,
    each refined from grams in the same way."""
    if width == gram:
        return grams[at]
    half = gram
    while 2 * half < width:
        half *= 2
    first, later = refined(grams, at, half, gram), refined(grams, at + width - half, half, gram)
    return mix64(first * np.uint64(0x9FB21C651E98DF25) + later + np.uint64(width))


def first_items(data: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """core, full, anchor, lo, n of the items of one text."""
    rolling = RollingHash(data)
    place, grams = anchors(rolling, len(data) - length + 1, length, gram)
    lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    n = np.diff(np.append(lo, len(place)))
    anchor = place[lo]
    return [grams[anchor].view(np.int64), _class(grams, anchor, lo, n, length, gram).view(np.int64), anchor, lo, n]


def _class(grams: np.ndarray, anchor: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Identifier of the text that windows lo .. lo + n - 1 cover (n is at most length), and of its place at the anchor."""
    ends = refined(grams, lo, length, gram) * np.uint64(0xA0761D6478BD642F) + refined(grams, lo + n - 1, length, gram)
    return mix64(ends + (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))


def blocks(data: np.ndarray, items: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Items (anchor, lo, n) split where the distance to the anchor is a multiple of BLOCK."""
    anchor, lo, n = items.T
    far, near = (anchor - lo) // BLOCK, (anchor - lo - n + 1) // BLOCK
    count = far - near + 1
    which = np.repeat(np.arange(len(n)), count)
    block = far[which] - (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
    anchor, lo, end = anchor[which], lo[which], (lo + n)[which]
    first = np.maximum(lo, anchor - block * BLOCK - BLOCK + 1)
    last = np.minimum(end, anchor - block * BLOCK + 1)
    grams = RollingHash(data).every(gram)
    core = refined(grams, anchor - block * BLOCK, length - BLOCK + 1, gram)
    return [core.view(np.int64), _class(grams, anchor, first, last - first, length, gram).view(np.int64), anchor, first, last - first]


def windows(data: np.ndarray, items: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Items as single windows."""
    anchor, lo, n = items.T
    which = np.repeat(np.arange(len(n)), n)
    at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    grams = RollingHash(data).every(gram)
    half = gram
    while 2 * half < length:
        half *= 2
    return [refined(grams, at, half, gram).view(np.int64), refined(grams, at, length, gram).view(np.int64), anchor[which], at, np.ones(len(at), np.int64)]


def _bytes(text) -> np.ndarray:
    buffer = text.as_buffer() if text.is_valid else None
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)


def _emit(found: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    parts: list[list[np.ndarray]] = []
    total = 0

    def out():
        columns = [np.concatenate(x) if parts else np.empty(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * len(_NAMES))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    for row, (core, full, *rest) in found:
        parts.append([core, full, np.full(len(core), row), *rest])
        total += len(core)
        if total > 100_000:
            yield out()
            parts, total = [], 0
    yield out()


def _items(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = _bytes(text)
                    if len(data) >= length:
                        yield row, first_items(data, length, gram)

        yield from _emit(found())

    return rows.mapInArrow(each, ITEM)


def _split(rows: DataFrame, decided: DataFrame, split, length: int, gram: int) -> DataFrame:
    """The items that go on, split by ``split`` with their text at hand."""
    lists = decided.where("go").groupBy("_row").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("items"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for row, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    flat = items.values.flatten()
                    yield row, split(_bytes(text), np.stack([np.asarray(x, np.int64) for x in flat], axis=1), length, gram)

        yield from _emit(found())

    return rows.join(lists, "_row").select("_row", "text", "items").mapInArrow(each, ITEM)


def _decide(items: DataFrame, what: str) -> DataFrame:
    """(_row, anchor, lo, n, repeats, go) of the items whose bucket has others. What is counted is a table of its own, so that
    Spark can split the join of a bucket that very many items share."""
    items = written(items, what)
    buckets = items.groupBy("core").agg(F.count("*").alias("size"), (F.min("full") != F.max("full")).alias("mixed")).where("size > 1").drop("size")
    shared = written(items.join(written(buckets, f"{what}-buckets"), "core"), f"{what}-shared")
    release(items)
    one = shared.where("not mixed").select("_row", "anchor", "lo", "n", F.lit(True).alias("repeats"), F.lit(False).alias("go"))
    mixed = shared.where("mixed")
    classes = mixed.groupBy("core", "full").agg(F.count("*").alias("members"), F.min("_row").alias("least"))
    rows = mixed.drop("mixed").join(written(classes, f"{what}-classes"), ["core", "full"]).select("_row", "anchor", "lo", "n", (F.col("members") > 1).alias("repeats"), (F.col("_row") == F.col("least")).alias("go"))
    decided = written(one.unionByName(rows), f"{what}-decided")
    release(shared)
    return decided


def repeated_windows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(_row, lo, n): runs of starting places of strings that start elsewhere too. rows: _row, text."""
    first = _decide(_items(rows, length, gram), "anchors")
    second = _decide(_split(rows, first, blocks, length, gram), "blocks")
    single = written(_split(rows, second, windows, length, gram), "windows")
    twice = single.groupBy("core", "full").agg(F.count("*").alias("size")).where("size > 1").select("core", "full")
    third = single.join(written(twice, "twice"), ["core", "full"], "left_semi")
    return first.where("repeats").select("_row", "lo", "n").unionByName(second.where("repeats").select("_row", "lo", "n")).unionByName(third.select("_row", "lo", "n"))


def dedup_bytes(docs: DataFrame, length: int = 200, gram: int = 32, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): every row of docs; spans are the removed [first, end) byte
    runs, kept the bytes that are left."""
    if not (BLOCK < length - gram and length >= 2 * gram):
        raise ValueError("length must be two grams at least, and exceed one by more than a block")
    rows = with_row_id(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("_row", "doc_id", "text")
    found = repeated_windows(rows.select("_row", "text"), length, gram)
    lists = found.groupBy("_row").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for d, t, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = _bytes(t)
                if not runs.is_valid:
                    out.append((d, len(data), 0, 0, [], data.tobytes()))
                else:
                    lo, n = (np.asarray(x, np.int64) for x in runs.values.flatten())
                    edge = np.zeros(len(data) + 2, np.int64)
                    np.add.at(edge, lo + 1, 1)
                    np.add.at(edge, lo + n + length, -1)
                    gone = np.cumsum(edge) > 0  # one place later than the bytes
                    spans = np.flatnonzero(np.diff(gone.astype(np.int8))).reshape(-1, 2)
                    out.append((d, len(data), int(gone.sum()), len(spans), spans.tolist(), data[~gone[1:-1]].tobytes()))
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names)

    return rows.join(lists, "_row", "left").select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
