"""n-gram Jaccard join, exact at a threshold: size-banded tiles with hashed bitmap signatures.

A document is its set of shingles (five words). Equal sets are one class, a node. Two sets of similarity t share one of
their first shingles in any common order (prefixes of n - ceil(t n) + 1), so only nodes that share such a shingle meet,
in the tile of that shingle and of their band of sizes; sizes of linked sets differ by t at most, which is one band.
In a tile, places in the order bound the overlap; for the pairs that are left, bitmap signatures bound it from above by
bit counts, and pairs that could still reach the threshold are verified by intersecting their
sorted arrays of 64-bit shingle hashes (two different shingles of a pair of sets of n would have to collide to count
wrongly: n * n in 2**64).

The common order puts rare shingles first, by exact frequency up to ``OFTEN`` and by hash among equals. One shuffle of all
postings counts them; a shingle that one row alone has makes no tile, so a node whose prefix is full of such is done. A
task passes on ``OFTEN`` postings of a shingle at most to be counted; that many show that it is frequent, and the others
say so themselves, so no task gets all rows of a shingle that many rows hold.

Links say who is in a component, and only that is kept. So groups of thousands of near copies are settled in rounds: in
each tile one node (another one each round) is the leader, each node of another component is held against the leaders
with which it shares most tiles, and links merge components. When a round settles few more pairs, all pairs of different
components that share a tile are compared, whatever their number: no link between components is lost.

``components`` returns components, by large-star and small-star rounds on the links (Kiveris et al. 2014).

Defined cases: null or empty text has an empty set and is linked with nothing; fewer than five words are one shingle;
rows that repeat an id, or have none, are nodes of their own, and a component's id is its smallest id; other columns
are ignored, whatever their names. docs must read the same rows each time (a table).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shingle_sets, with_row_id, written

LEAST_BITS = 1024  # of a bitmap signature; a set of more elements has the next power of two
OFTEN = 256  # frequencies from here on count as one
ROUNDS = 8  # of leaders, at most
LEADERS = 8  # that a node is held against in a round


def signature(shingles: np.ndarray) -> bytes:
    size = max(LEAST_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes) -> int:
    """Upper bound of the intersection size: each bit that only one set has is an element that only it has. A longer
    bitmap is folded to the shorter one's length."""
    a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def prefix_size(n, percent: int):
    """Of n elements in order, how many decide whether any link is possible."""
    return n + (-percent * n // 100) + 1


def linked(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


# --- passes over the texts ---------------------------------------------------------------------------------


def _classes(rows: DataFrame) -> DataFrame:
    """(_row, doc_id, n_shingles, key) of every row; key is null for an empty set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for shingles in shingle_sets(batch.column(2)):
                sizes.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_row", "doc_id", "n_shingles", "key"])

    return rows.select("_row", "doc_id", "text").mapInArrow(each, "_row long, doc_id long, n_shingles long, key binary")


def _postings(rows: DataFrame) -> DataFrame:
    """(shingle, node): the shingles of each row. Those of a shingle of which the task has passed on ``OFTEN`` have -1 - node
    for node: they are frequent and need no counting."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[int, int] = {}

        def out(sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
            shingle, node = np.concatenate(sets), np.repeat(np.array(nodes, np.int64), [len(x) for x in sets])
            order = np.argsort(shingle, kind="stable")
            by = shingle[order]
            first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
            size = np.diff(np.append(first, len(by)))
            for k in np.flatnonzero(size >= 8).tolist():  # fewer of a batch can't make a shingle hot
                at, n, key = int(first[k]), int(size[k]), int(by[first[k]])
                free = OFTEN - passed.get(key, 0)
                passed[key] = min(OFTEN, passed.get(key, 0) + n)
                if n > free:
                    some = order[at + free : at + n]
                    node[some] = -1 - node[some]
            # rows of one node stay together: they compress better
            return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(node)], ["shingle", "node"])

        for batch in batches:
            sets: list[np.ndarray] = []
            nodes: list[int] = []
            held = 0
            for node, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if len(shingles):
                    sets.append(shingles)
                    nodes.append(node)
                    held += len(shingles)
                if held > 1 << 20:
                    yield out(sets, nodes)
                    sets, nodes, held = [], [], 0
            if sets:
                yield out(sets, nodes)

    return rows.select("_row", "text").mapInArrow(each, "shingle long, node long")


def _shared(postings: DataFrame) -> DataFrame:
    """(node, shingle, level): postings whose shingle another row has, with its place in the order. One shuffle, and one
    pass that holds ``OFTEN`` postings of a shingle."""
    names = ["node", "shingle", "level"]

    def out(shingle: np.ndarray, node: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(shingle), pa.array(np.minimum(level, OFTEN).astype(np.int32))], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, node, often = np.empty(0, np.int64), np.empty(0, np.int64), None  # the last run, and a shingle whose run is passed on
        for batch in batches:
            s, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if (known := v < 0).any():
                yield out(s[known], -1 - v[known], np.full(int(known.sum()), OFTEN))
                s, v = s[~known], v[~known]
            s, v = np.concatenate((shingle, s)), np.concatenate((node, v))
            if not len(s):
                continue
            if often is not None:
                n = int(np.searchsorted(s, often, "right"))
                if n:
                    yield out(s[:n], v[:n], np.full(n, OFTEN))
                    s, v = s[n:], v[n:]
                if not len(s):
                    shingle, node = s, v
                    continue
                often = None
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            end = int(first[-1])
            if len(s) - end >= OFTEN:
                often, end = int(s[-1]), len(s)
                first = np.append(first, end)
            size = np.repeat(np.diff(first), np.diff(first))
            if (many := size > 1).any():
                yield out(s[:end][many], v[:end][many], size[many])
            shingle, node = s[end:], v[end:]
        if len(shingle) > 1:
            yield out(shingle, node, np.full(len(shingle), len(shingle)))

    dealt = F.when(F.col("node") < 0, F.xxhash64("node")).otherwise(F.col("shingle"))
    return postings.repartition(dealt).sortWithinPartitions("shingle").mapInArrow(each, "node long, shingle long, level int")


def _tiles(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, at): the prefix shingles of each node that other rows have, and how many come before each in the
    set's order. nodes: node, n_shingles."""
    lists = shared.groupBy("node").agg(F.collect_list("shingle").alias("shingles"), F.collect_list("level").alias("levels"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int, int]] = []
            for k, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("n_shingles").to_pylist(), strict=True)):
                shingle, level = (batch.column(c)[k].values.to_numpy() for c in ("shingles", "levels"))
                left = prefix_size(n, percent) - (n - len(shingle))  # of the prefix, after those that this row alone has
                if left > 0:
                    parts.append((shingle[np.lexsort((shingle, level))][:left], node, n, n - len(shingle)))
            if parts:
                sizes = [len(p[0]) for p in parts]
                node, n, before = (np.repeat([p[k] for p in parts], sizes) for k in (1, 2, 3))
                at = before + np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([p[0] for p in parts]), node, n, at)], ["shingle", "node", "n", "at"])

    return lists.join(nodes, "node").mapInArrow(each, "shingle long, node long, n long, at long")


def _sets(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """(node, n, bits, elements) of the nodes in tiles: bitmap and sorted array."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            made = [pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["node", "n", "bits", "elements"])

    few = tiles.select(F.col("node").alias("_row")).distinct()
    return rows.join(few, "_row", "left_semi").select("_row", "text").mapInArrow(each, "node long, n long, bits binary, elements binary")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int, what: str) -> DataFrame:
    """The pairs (a, b) whose sets are linked, written: bitmaps leave those that may be, arrays decide."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of = zip(*(batch.column(c).to_pylist() for c in ("na", "bits_a", "nb", "bits_b")), strict=True)
            may = [linked(overlap_bound(na, a, nb, b), na, nb, percent) for na, a, nb, b in rows_of]
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(right, left)
                common = int((right[np.minimum(at, len(right) - 1)] == left).sum())
                keep.append(linked(common, len(left), len(right), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    few = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"e{x}"))
    near = written(pairs.join(few("a"), "a").join(few("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long"), f"{what}-near")
    return written(near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb").mapInArrow(exact, "a long, b long"), f"{what}-links")


# --- candidates --------------------------------------------------------------------------------------------


def _mixed(tiles: DataFrame, known: DataFrame | None) -> DataFrame:
    """(shingle, node, n, at, group, share): tiles with each node's component, where a shingle has nodes of several. Shares sum
    to the number of pairs of different components."""
    rows = tiles.withColumn("group", F.col("node"))
    if known is not None:
        rows = tiles.join(known, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    sizes = rows.groupBy("shingle", "group").agg(F.count("*").cast("double").alias("c"))
    mixed = sizes.groupBy("shingle").agg(((F.sum("c") - F.sum(F.col("c") * F.col("c")) / F.sum("c")) / 2).alias("share"), F.count("*").alias("groups")).where("groups > 1")
    return rows.join(mixed.drop("groups"), "shingle").select("shingle", "node", "n", "at", "group", "share")


def _band(n: str, percent: int, shift: float = 0.0):
    """Bands a little wider than the ratio, so that rounding never sets a linked pair two bands apart."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.1 / percent)) + shift).cast("int")


def _reach(percent: int, x: str, y: str) -> str:
    """Whether two sets whose first common element in order is the tile's shingle can have enough in common: at most what
    each of them holds from there on. Rows of later common elements may fail this; that of the first one never does where
    a link is."""
    need = f"{percent} * (n{x} + n{y})"
    return f"{100 + percent} * (n{x} - at{x}) >= {need} and {100 + percent} * (n{y} - at{y}) >= {need}"


def _leader_pairs(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b), distinct: each node with up to ``LEADERS`` of the leaders of its tiles, those of most tiles, that are of other
    components. The first turn's leader is the node with fewest rarer shingles, the middle of a group of copies; the others
    are any. Bands shift by half their width."""
    rows = mixed.withColumn("band", _band("n", percent, turn % 2 / 2))
    place = F.struct(F.xxhash64(F.lit(turn), "shingle", "node").alias("h") if turn else F.col("at").alias("h"), "node", "group", "n", "at")
    leads = rows.groupBy("shingle", "band").agg(F.min(place).alias("l"), (F.min("group") != F.max("group")).alias("several")).where("several")
    leads = leads.select("shingle", "band", *[F.col(f"l.{c}").alias(f"{c}b") for c in ("node", "group", "n", "at")])
    rows = rows.select("shingle", "band", *[F.col(c).alias(f"{c}a") for c in ("node", "group", "n", "at")])
    votes = rows.join(leads, ["shingle", "band"]).where(f"groupa <> groupb and {_reach(percent, 'a', 'b')}").groupBy("nodea", "nodeb").count()
    best = votes.groupBy("nodea").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "nodeb")), asc=False), 1, LEADERS).alias("b"))
    return best.select(F.col("nodea").alias("a"), F.explode("b.nodeb").alias("b"))


def _tile_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b), distinct: nodes of different components that share a prefix shingle and whose sizes and places in the order
    allow a link. The larger of a pair looks up the smaller in the tile of the shingle and of the larger one's band. A node
    is the smaller one only where its place allows a link with a set of its own size, so a tile in which no node's place
    does (the frame of texts that are alike by less than the threshold) makes no pair at all."""
    rows = mixed.withColumn("band", _band("n", percent))
    large = rows.select("shingle", "band", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("group").alias("gb"), F.col("at").alias("atb"))
    small = rows.where(f"{100 + percent} * (n - at) >= {2 * percent} * n").select("shingle", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("group").alias("ga"), F.col("at").alias("ata"))
    pairs = large.join(small, ["shingle", "band"]).where(f"ga <> gb and 100 * na >= {percent} * nb and (na < nb or na = nb and a < b) and {_reach(percent, 'a', 'b')}")
    return pairs.select("a", "b").distinct()


# --- components --------------------------------------------------------------------------------------------


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, of every node in links (a, b) but those that are it."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "edges")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def links(docs: DataFrame, percent: int = 75, doc: str = "doc_id", text: str = "text", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, components). ``row`` names a column of distinct row numbers, if docs has one. members: _row, doc_id, n_shingles, node for every row; node is null for an empty set.
    components: node, component of the nodes whose component is another node."""
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *([F.col(f"`{row}`").alias("_row")] if row else []))
    rows = (rows if row else with_row_id(rows)).select("_row", "doc_id", "text")
    classes = written(_classes(rows), "classes")
    named = classes.where("key is not null").groupBy("key").agg(F.min("_row").alias("node"))
    members = written(classes.join(named, "key", "left").select("_row", "doc_id", "n_shingles", "node"), "members")
    release(classes)
    shared = written(_shared(_postings(rows)), "shared")  # the postings' shuffle files go before the next shuffle
    tiles = written(_tiles(shared, members.where("_row = node").select("node", "n_shingles"), percent), "tiles")
    release(shared)
    several = tiles.groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1").select("shingle")
    before, tiles = tiles, written(tiles.join(several, "shingle", "left_semi").select("shingle", "node", "n", "at"), "tiles")
    release(before)
    sets = written(_sets(rows, tiles), "sets")
    known = None
    before = float("inf")
    for turn in range(ROUNDS + 1):
        last, tiles = tiles, written(_mixed(tiles.select("shingle", "node", "n", "at"), known), "mixed")
        release(last)
        left = tiles.agg(F.count("*").alias("rows"), F.sum("share").alias("pairs")).first()
        if turn == ROUNDS or not left.rows or left.pairs > 0.9 * before:
            break
        before = left.pairs
        found = _verified(sets, written(_leader_pairs(tiles, turn, percent), "leaders"), percent, "leader")
        if found.isEmpty():
            break
        known = connected_components(found if known is None else found.union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = _verified(sets, written(_tile_pairs(tiles, percent), "pairs"), percent, "tile")
    if known is None or not found.isEmpty():
        known = connected_components(found if known is None else found.union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return members, known


def _grouped(docs: DataFrame, percent: int, **options) -> DataFrame:
    """(_row, doc_id, n_shingles, component) of every row; component is null for an empty set."""
    members, found = links(docs, percent, **options)
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def components(docs: DataFrame, percent: int = 75, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    members = _grouped(docs, percent, **options)
    ids = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(ids, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keepers(docs: DataFrame, percent: int = 75, **options) -> DataFrame:
    """(_row) of the rows that stay: of each component that of the smallest (doc_id, _row), ids before nulls, and each
    row of an empty set. _row is that of ``row``, or of ``with_row_id`` on docs."""
    members = _grouped(docs, percent, **options).select("_row", "doc_id", "component")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = members.where("component is not null").groupBy("component").agg(F.min(place).alias("at")).select(F.col("at._row").alias("_row"))
    return first.unionByName(members.where("component is null").select("_row"))
