"""Spelling variants by permuterm rotations: every rotation of a word that ends in a terminator is sorted, once whole and
once without its last character. Words that differ by one replaced character share a rotation without it, and a word with
one character less has that as a whole rotation, so that all neighbours lie in one range of the sorted rotations. A
scan gives each member its count of neighbours and its best one; no pairs are made.

A range holds words that differ in one character at one place, so it has at most as many members as there are letters.
Words are numbered by falling count, then by code points: the best neighbour is the smallest number, and rotations carry
that number in place of words. A rotation is held by its first ``HEAD`` code points, and the rest of a longer one by its
length and a 127-bit polynomial hash, so that a word of a million letters needs no million copies of itself; on that hash
alone the neighbours of such words rest.

Defined cases: null and empty texts have no words; a document with a null id has an empty one in its hash, and repeated
rows count each; words of equal count take the smaller by code points; other columns of documents, whatever their
names, are not read; no words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written
from .decontam import ascii_lower

LETTERS = "A-Za-zÀ-ÿ"
END = "$"  # in no word
HEAD = 32
_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME


def dropped(run: Column, doc: Column, one_in: int) -> Column:
    """The run without the code point that its hash with the document's id names, if ``one_in`` divides that."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, one_in: int | None = 31, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the maximal runs of letters, A-Z lower-cased, with deletions by hash unless ``one_in`` is None."""
    runs = docs.select(F.col(doc).alias("doc"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select((dropped(F.col("run"), F.col("doc"), one_in) if one_in else F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def numbered(words: DataFrame, ranges: int = 64) -> DataFrame:
    """(id, word, n): places, from 0, in the order of falling n, then of the word; a table."""
    order = [F.desc("n"), F.asc("word")]
    dealt = written(words.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "words")
    before = dealt.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    out = written(dealt.withColumn("inner", inner).join(F.broadcast(before), "part").select((F.col("inner") + F.col("before")).alias("id"), "word", "n"), "word-numbers")
    release(dealt)
    return out


def _keys(ring: str, first: int, width: int, last: int) -> Iterator[bytes]:
    """Keys of the substrings of this width that begin at first..last: themselves, or head, length and hash of the rest."""
    if width <= HEAD:
        for i in range(first, last + 1):
            yield ring[i : i + width].encode()
        return
    rest = width - HEAD
    power = pow(_BASE, rest, _PRIME)
    h = 0
    for c in ring[first + HEAD : first + width]:
        h = (h * _BASE + ord(c)) % _PRIME
    for i in range(first, last + 1):
        yield ring[i : i + HEAD].encode() + b"\0" + rest.to_bytes(8) + h.to_bytes(16)
        if i < last:
            h = (h * _BASE + ord(ring[i + width]) - power * ord(ring[i + HEAD])) % _PRIME


#: Roles of a rotation in its range: whole; without its last character; the same, where that repeats the one before it, so
#: that its deletion is the same word as theirs.
WHOLE, CUT, REPEATED = 0, 1, 2


def rotations(batches: Iterator[pa.RecordBatch], most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """(key, id, role) of every rotation of each word, whole and without its last character (unless that is the terminator)."""
    keys, ids, roles = [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(roles, pa.int8())], ["key", "id", "role"])

    for batch in batches:
        for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            n, ring = len(word), (word + END) * 2
            for role, found in ((WHOLE, _keys(ring, 0, n + 1, n)), (CUT, _keys(ring, 1, n, n))):
                for at, key in enumerate(found):
                    keys.append(key)
                    ids.append(i)
                    roles.append(REPEATED if role == CUT and at and word[at] == word[at - 1] else role)
                    if len(keys) >= most:
                        yield out()
                        keys, ids, roles = [], [], []
    if keys:
        yield out()


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, best) of each member of each range that has neighbours in it. The rows are sorted by key; the last range of
    a batch waits for the next."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not len(table):
            continue
        starts = _starts(table)
        waiting = table.slice(starts[-1])
        if len(starts) > 1:
            yield from _neighbours(table.slice(0, starts[-1]), starts[:-1])
    if waiting is not None and len(waiting):
        yield from _neighbours(waiting, np.zeros(1, np.int64))


def _starts(table: pa.Table) -> np.ndarray:
    keys = table.column("key").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    differs = np.ones(len(keys), bool)
    if len(keys) > 1:
        differs[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def _neighbours(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, roles = table.column("id").to_numpy(), table.column("role").to_numpy()
    sizes = np.diff(np.append(starts, len(ids)))
    group = np.repeat(np.arange(len(starts)), sizes)
    none = np.iinfo(np.int64).max
    add, least = np.add.reduceat, np.minimum.reduceat
    whole, first = roles == WHOLE, roles == CUT
    of_whole = least(np.where(whole, ids, none), starts)  # the one whole rotation of a range, if it has one
    cuts, firsts = add((~whole).astype(np.int64), starts), add(first.astype(np.int64), starts)
    best = least(np.where(whole, none, ids), starts)  # of those without their last character, and the second
    second = least(np.where(whole | (ids == best[group]), none, ids), starts)
    best_first = least(np.where(first, ids, none), starts)
    with_whole = first & (of_whole[group] != none)
    near = np.where(whole, firsts[group], cuts[group] - 1 + with_whole)
    other = np.where(ids == best[group], second[group], best[group])
    nearest = np.where(whole, best_first[group], np.where(with_whole, np.minimum(other, of_whole[group]), other))
    some = near > 0
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near[some]), pa.array(nearest[some])], ["id", "near", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each numbered word that has neighbours their count and the smallest number among them."""
    spun = words.select("id", "word").mapInArrow(rotations, "key binary, id long, role byte")
    found = spun.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "id long, near long, best long")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words with a form, from (id, form): pointers are followed, their length doubling each round, until
    they end. Counts grow at least by a factor along a way, so that a handful of rounds ends any."""
    at = forms.select("id", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = written(at.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        at = after.select("id", "root")


def variant_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counted words (word, n): the form of a word is its neighbour of the largest
    count, the first by code points among equals, if that count is at least ``factor`` (over 1) times its own; the root
    is the last of the forms' forms, or the word itself."""
    if factor <= 1:
        raise ValueError("factor must be over 1")
    known = numbered(words)
    near = known.join(neighbours(known), "id", "left")
    best = known.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    near = written(near.join(best, "best", "left").withColumn("formed", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))), "near-words")
    ends = roots(near.where("formed").select("id", F.col("best").alias("form")))
    of_root = known.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ends = ends.join(of_root, "root").select("id", "root_word")
    form = lambda c: F.when(F.col("formed"), F.col(c))
    return near.join(ends, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form("best_word").alias("form"), form("best_n").alias("form_n"), F.coalesce("root_word", "word").alias("root"))
