"""Line dedup that can be taken back: an exact table of references (line key, document), an exact count table made
from it, and sharded cuckoo filters over the keys that are to be dropped.

A key is a line stripped of white space with A-Z lower-cased. A key of at least ``min_chars`` code points that at
least ``min_docs`` documents hold loses its lines in all of them but the largest id. Inserting or deleting
documents writes the references, counts and filter shards that it touches and nothing else (references are read once to
count the touched keys anew), so a deletion brings lines back; ``compact`` writes one table of each again. Shards split
when keys outgrow them.

References are held against the filters before they are shuffled to the counts: with filters of up to
``broadcast_bytes`` where they are, else shard by shard, each shard's references dealt over ``SALTS`` tasks.

Defined cases: null or empty text is one empty line; rows with a null id are left as they are and count nowhere;
rows that repeat an id count as one document in counts, and each row is treated; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, written


SALTS = 16


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets. ``insert`` says False if it is full."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, data: bytes | None = None):
        if data is None:
            n = 1 << max(1, int(np.ceil(capacity / (self.SLOTS * 0.84))) - 1).bit_length()
            self.cells = np.zeros((n, self.SLOTS), np.uint16)
        else:
            self.cells = np.frombuffer(data, np.uint16).reshape(-1, self.SLOTS).copy()
        self.mask = len(self.cells) - 1

    def bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: the first 8 bytes of digests, as uint64."""
        prints = (keys & np.uint64(0xFFFF)).astype(np.int64)
        prints[prints == 0] = 1
        a = (keys >> np.uint64(24)).astype(np.int64) & self.mask
        return prints, a, self._other(a, prints)

    def _other(self, bucket, prints):
        return bucket ^ ((prints * 0x5BD1E995) >> 7 & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(keys)
        return ((self.cells[a] == f[:, None]) | (self.cells[b] == f[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        rng = np.random.default_rng(7)
        cells = self.cells
        for f, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                if (free := np.flatnonzero(cells[at] == 0)).size:
                    cells[at, free[0]] = f
                    break
            else:
                at = a
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    f, cells[at, slot] = int(cells[at, slot]), f
                    at = int(self._other(at, f))
                    if (free := np.flatnonzero(cells[at] == 0)).size:
                        cells[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted."""
        for f, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (a, b):
                if (own := np.flatnonzero(self.cells[at] == f)).size:
                    self.cells[at, own[0]] = 0
                    break


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, or None if the key is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


FILTERS = "shard int, cells binary"


def _head(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), ">u8").astype(np.uint64)


def references(docs: DataFrame, min_chars: int = 20, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id), distinct within each row of docs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for line in (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := line_key(line, min_chars))}
                ids += [d] * len(found)
                out += found
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
                    ids, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    known = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return known.mapInArrow(keys, "key binary, doc_id long")


@dataclass
class LineIndex:
    """What is stored: refs (key, doc_id), counts (key, refs, max_doc), filters (shard, cells)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 20
    min_docs: int = 3
    keys_per_shard: int = 100_000
    broadcast_bytes: int = 32 << 20

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 100_000, **options) -> LineIndex:
        refs = written(references(docs, min_chars, **options), "line-refs")
        index = cls(refs, written(cls._count(refs), "line-counts"), None, 1, min_chars, min_docs, keys_per_shard)
        return index._sharded()

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return refs.groupBy("key", "doc_id").agg(F.lit(1).alias("n")).groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("max_doc"))

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _over(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs)

    def _sharded(self) -> LineIndex:
        """Filters made from the counts, in as many shards as the keys need."""
        self.shards = 1 << max(0, self._over().count() // self.keys_per_shard).bit_length()
        self.filters = self._made(self._over())
        return self

    def _made(self, over: DataFrame) -> DataFrame:
        """Filters of all of these keys."""

        def make(key, keys: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter(len(keys))
            while not cuckoo.insert(_head(keys["key"])):
                cuckoo = CuckooFilter(2 * cuckoo.cells.size)
            return pd.DataFrame({"shard": [key[0]], "cells": [cuckoo.bytes()]})

        keys = over.select("key", self._shard())
        return written(keys.groupBy("shard").applyInPandas(make, FILTERS), "line-filters")

    def _changed(self, refs: DataFrame, difference: DataFrame) -> LineIndex:
        """The index over refs, which differ from the present ones by the keys of ``difference``."""
        touched = written(difference.select("key").distinct(), "line-touched")
        new = written(self._count(refs.join(touched, "key", "left_semi")), "line-counts")
        old = self.counts.join(touched, "key", "left_semi").select("key", F.col("refs").alias("before"))
        counts = self.counts.join(touched, "key", "left_anti").unionByName(new)
        after = LineIndex(refs, counts, None, self.shards, self.min_chars, self.min_docs, self.keys_per_shard, self.broadcast_bytes)
        if after._over().count() > 2 * self.keys_per_shard * self.shards:
            return after._sharded()
        low = self.min_docs
        both = new.select("key", F.col("refs").alias("after")).join(old, "key", "full").fillna(0, ["before", "after"])
        crossed = both.where((F.col("before") >= low) != (F.col("after") >= low)).select("key", (F.col("after") >= low).alias("now"), self._shard())
        crossed = written(crossed, "line-crossed")
        shards = crossed.select("shard").distinct()

        def update(key, have: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter(data=have["cells"].iloc[0]) if len(have) else CuckooFilter(len(keys))
            cuckoo.delete(_head(keys.loc[~keys["now"], "key"]))
            full = not cuckoo.insert(_head(keys.loc[keys["now"], "key"]))
            return pd.DataFrame({"shard": [key[0]], "cells": [None if full else cuckoo.bytes()]})

        mine = self.filters.join(shards, "shard", "left_semi")
        done = written(mine.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, FILTERS), "line-filters")
        after.filters = self.filters.join(shards, "shard", "left_anti").unionByName(done.where("cells is not null"))
        full = done.where("cells is null").select("shard")
        if not full.isEmpty():  # made anew from the exact counts
            keys = after._over().select("key").withColumn("shard", after._shard()).join(full, "shard", "left_semi")
            after.filters = after.filters.unionByName(after._made(keys.select("key")))
        return after

    def insert(self, docs: DataFrame, **options) -> LineIndex:
        new = written(references(docs, self.min_chars, **options), "line-refs")
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """ids: one column doc_id. Their lines no longer count."""
        ids = written(ids.select("doc_id").distinct(), "line-deleted")
        gone = self.refs.join(ids, "doc_id", "left_semi")
        return self._changed(self.refs.join(ids, "doc_id", "left_anti"), gone)

    def compact(self) -> LineIndex:
        """The same index as one table of references, counts and filters each, so that reads don't pass over all changes."""
        tables = (written(self.refs, "line-refs"), written(self.counts, "line-counts"), written(self.filters, "line-filters"))
        return LineIndex(*tables, self.shards, self.min_chars, self.min_docs, self.keys_per_shard, self.broadcast_bytes)

    def _probed(self) -> DataFrame:
        """The references whose keys the filters hold."""
        refs = self.refs.withColumn("shard", self._shard())
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
        if size <= self.broadcast_bytes:
            sent = refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cells) for r in self.filters.collect()})

            def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                filters = {k: CuckooFilter(data=v) for k, v in sent.value.items()}
                for rows in batches:
                    keep = np.zeros(len(rows), bool)
                    for shard, at in rows.groupby("shard").indices.items():
                        if shard in filters:
                            keep[at] = filters[shard].contains(_head(rows["key"].iloc[at]))
                    yield rows.loc[keep, ["key", "doc_id"]]

            return refs.mapInPandas(probe, "key binary, doc_id long")

        def probe_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, cuckoo = None, None  # a shard's filter comes before its references
            for rows in batches:
                for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows["shard"]) | rows["cells"].notna()[1:]) + 1):
                    some = rows.iloc[at]
                    if len(some) and some["cells"].notna().iloc[0]:
                        shard, cuckoo = some["shard"].iloc[0], CuckooFilter(data=some["cells"].iloc[0])
                        some = some.iloc[1:]
                    if len(some) and some["shard"].iloc[0] == shard:
                        yield some.loc[cuckoo.contains(_head(some["key"])), ["key", "doc_id"]]

        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "cells", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
        asked = refs.select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("cells"), "key", "doc_id")
        dealt = held.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("cells").isNull())
        return dealt.mapInPandas(probe_shards, "key binary, doc_id long")

    def dropped(self) -> DataFrame:
        """(doc_id, keys): the line keys that each document loses. Filters pass on what may be dropped; the exact
        counts decide."""
        hits = self._probed().join(self._over(), "key").where(F.col("doc_id") != F.col("max_doc"))
        return hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, kept columns, n_lines, n_dropped, text): every row of docs with its remaining lines joined by \\n."""
        min_chars = self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for t, keys in zip(batch.column("text"), batch.column("keys"), strict=True):
                    lines = (t.as_py() or "").split("\n")
                    gone = set(keys.as_py() or ())
                    kept = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass"), min_chars) not in gone] if gone else lines
                    out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
                columns = zip(*out, strict=True) if out else ([],) * 3
                made = [pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
                rest = ["kept"] if keep else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *map(batch.column, rest)], ["doc_id", "n_lines", "n_dropped", "text", *rest])

        kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
        rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), kept.alias("kept"))
        schema = "doc_id long, n_lines long, n_dropped long, text string" + (f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else "")
        found = rows.join(self.dropped(), "doc_id", "left").select("doc_id", "text", "keys", *(["kept"] if keep else [])).mapInArrow(cut, schema)
        return found.select("doc_id", *[F.col(f"kept.`{c}`").alias(c) for c in keep], "n_lines", "n_dropped", "text")
