"""Substring dedup over sliding sentence spans: every run of ``width`` consecutive sentences is hashed, the hashes
meet in one global pass, and a sentence that any non-first repeat covers goes.

A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line end. Its words decide where a longer one is
cut: in each ``part_words`` w consecutive words of a sentence, after the (last) one of least hash. So parts have w words
at most, and cuts are the same in equal passages except next to their edges: a word that has w - 1 words of the passage
on either side is cut after in both or in none. With width 3 and w = 8 any 51 words that two places share (with their
sentence ends) hold a whole run, since its 24 words at most begin within 15 words and end before the last 7. Parts count
as sentences. Runs are equal when their words are (between ASCII white space, A-Z lower-cased; 96 bits of hash). A run of
fewer than ``min_words`` words is extended by the sentences after it until it has as many; where the text ends before
that, the last run is extended by those before it instead; a whole text of fewer words or fewer than ``width`` sentences
is one run. The first of equal runs is that of the smallest (row, sentence), rows in the order of the files; the rest go.

A task knows of a run that it has passed on with a smaller row already: such rows aren't compared again, so no task gets
all rows of a passage that many documents share.

Defined cases: null text is empty and loses nothing, as does text without words; null and repeated ids are rows of their
own; a long text is taken whole; other columns are ignored, whatever their names. docs must read the same rows each time
(a table).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, lowered, sequence_hash, text_groups, with_row_id, word_places, written

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


@dataclass
class Parts:
    """The parts of a group of texts."""

    data: np.ndarray
    offsets: np.ndarray  # of the texts
    starts: np.ndarray  # of the words
    hashes: np.ndarray
    edges: np.ndarray  # first word of each part, and the number of words
    first: np.ndarray  # first part of each text, and the number of parts

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, part_words: int) -> Parts:
        low = lowered(data)
        starts, ends, word = word_places(low, offsets)
        hashes = RollingHash(low).at(starts, ends)
        n = len(starts)
        line_ends = np.concatenate(([0], np.cumsum(data == 10)))
        cut = _ENDS[data[ends - 1]] if n else np.empty(0, bool)
        cut = cut | (line_ends[np.append(starts[1:], len(data))[:n]] > line_ends[ends])
        cut[word[1:][word[1:] > word[:-1]] - 1] = True  # the last word of each text
        if n >= part_words:
            ended = np.cumsum(cut) - cut  # sentence ends before each word
            at = np.flatnonzero(ended[: n - part_words + 1] == ended[part_words - 1 :])
            windows = np.lib.stride_tricks.sliding_window_view(hashes, part_words)[at, ::-1]
            cut[at + part_words - 1 - windows.argmin(axis=1)] = True
        edges = np.concatenate(([0], np.flatnonzero(cut) + 1))
        return cls(data, offsets, starts, hashes, edges, np.searchsorted(edges[:-1], word))

    def runs(self, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first part and end of each compared run, by text and place."""
        n = len(self.edges) - 1
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        start = np.arange(n)
        end = np.maximum(np.searchsorted(self.edges, self.edges[:-1] + min_words), start + width)
        inside = end <= self.first[1:][text]
        text, start, end = text[inside], start[inside], end[inside]
        open_ = self.first[1:] > self.first[:-1]  # texts whose last sentence no run holds
        open_[text[end == self.first[1:][text]]] = False
        rest = np.flatnonzero(open_)
        low, high = self.first[rest], self.first[rest + 1]
        enough = np.searchsorted(self.edges, self.edges[high] - min_words, "right") - 1
        last = np.maximum(low, np.minimum(high - width, enough))
        order = np.argsort(np.concatenate((text, rest)), kind="stable")
        return tuple(np.concatenate(x)[order] for x in ((text, rest), (start, last), (end, high)))

    def run_hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of each run's words."""
        a, b = self.edges[start], self.edges[end]
        more = sequence_hash(self.hashes, a, b, 2) & np.uint64(0xFFFFFFFF)
        return sequence_hash(self.hashes, a, b, 1).view(np.int64), more.astype(np.uint32).view(np.int32)

    def bytes_of(self) -> np.ndarray:
        """First byte of each part: a text's first part begins with it, the others with their first word."""
        places = self.starts[self.edges[:-1]] if len(self.starts) else np.empty(0, np.int64)
        some = self.first[:-1][self.first[:-1] < self.first[1:]]
        places[some] = self.offsets[:-1][self.first[:-1] < self.first[1:]]
        return places


def _first_in_text(text: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a run is the first of its words in its text."""
    order = np.lexsort((c, h, text))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)
    out = np.empty(len(text), bool)
    out[order] = new
    return out


def spans_of(rows: DataFrame, width: int, min_words: int, part_words: int) -> DataFrame:
    """rows: _row, text. (h, c, row, run): the first run of each kind in each row. Where the task has passed on the kind
    with a smaller row, row is -1 - row."""
    names = ["h", "c", "row", "run"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in text_groups(batch.column(1)):
                parts = Parts.of(data, offsets, part_words)
                text, start, end = parts.runs(width, min_words)
                h, c = parts.run_hashes(start, end)
                number = np.arange(len(text)) - np.searchsorted(text, text)
                new = _first_in_text(text, h, c)
                h, c, row, number = h[new], c[new], ids[at + text[new]], number[new]
                order = np.lexsort((row, c, h))
                h, c, row, number = h[order], c[order], row[order], number[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.empty(0, np.int64)
                size = np.diff(np.append(first, len(h)))
                for k in np.flatnonzero(size >= 4).tolist():  # of a group; fewer can't make a run hot
                    x, n = int(first[k]), int(size[k])
                    key = (int(h[x]), int(c[x]))
                    before = least.get(key)
                    later = row[x : x + n] > (row[x] if before is None else min(before, row[x]))
                    least[key] = int(row[x]) if before is None else min(before, int(row[x]))
                    row[x : x + n] = np.where(later, -1 - row[x : x + n], row[x : x + n])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(row), pa.array(number.astype(np.int32))], names)

    return rows.select("_row", "text").mapInArrow(each, "h long, c int, row long, run int")


def _later(spans: DataFrame) -> DataFrame:
    """(row, run) of the runs that a smaller row has. One shuffle, and one pass that holds the last run's hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h, c, row, run = (batch.column(k).to_numpy() for k in range(4))
            known = row < 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(-1 - row[known]), pa.array(run[known])], ["row", "run"])
                h, c, row, run = h[~known], c[~known], row[~known], run[~known]
            if len(h):
                again = np.concatenate(([last == (h[0], c[0])], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
                last = (h[-1], c[-1])
                yield pa.RecordBatch.from_arrays([pa.array(row[again]), pa.array(run[again])], ["row", "run"])

    dealt = F.when(F.col("row") < 0, F.xxhash64("row")).otherwise(F.col("h"))
    return spans.repartition(dealt).sortWithinPartitions("h", "c", "row").mapInArrow(each, "row long, run int")


def dedup_spans(docs: DataFrame, width: int = 3, min_words: int = 12, part_words: int = 8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text): every row of docs; ``removed`` lists [first, end) runs of
    removed sentence numbers and ``text`` is what is left."""
    rows = with_row_id(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("_row", "doc_id", "text")
    later = _later(spans_of(rows, width, min_words, part_words))
    later = written(later.groupBy("row").agg(F.collect_list("run").alias("found")), "later").withColumnRenamed("row", "_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2)
            for at, data, offsets in text_groups(batch.column(1)):
                parts = Parts.of(data, offsets, part_words)
                owner, start, end = parts.runs(width, min_words)
                h, c = parts.run_hashes(start, end)
                again = ~_first_in_text(owner, h, c)
                of = np.searchsorted(owner, np.arange(len(offsets)))
                places = np.append(parts.bytes_of(), len(data))
                out: list[tuple] = []
                for k in range(len(offsets) - 1):
                    a, b = int(of[k]), int(of[k + 1])
                    p, q = int(parts.first[k]), int(parts.first[k + 1])
                    gone = again[a:b].copy()
                    if found[at + k].is_valid:
                        # all runs of the kinds that an earlier row has
                        kinds_of = h[a:b]
                        gone |= np.isin(kinds_of, kinds_of[np.asarray(found[at + k].as_py())])
                    body = data[offsets[k] : offsets[k + 1]]
                    edge = np.zeros(q - p + 1, np.int64)
                    np.add.at(edge, start[a:b][gone] - p, 1)
                    np.add.at(edge, end[a:b][gone] - p, -1)
                    removed = np.cumsum(edge[:-1]) > 0
                    cuts = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))).reshape(-1, 2)
                    if len(cuts):
                        keep = np.ones(len(body), bool)
                        for x, y in cuts.tolist():
                            keep[places[p + x] - offsets[k] : (places[p + y] if p + y < q else offsets[k + 1]) - offsets[k]] = False
                        body = body[keep]
                    out.append((ids[at + k], q - p, int(removed.sum()), cuts.tolist(), body.tobytes().decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_sentences", "n_removed", "removed", "text"])

    return rows.join(later, "_row", "left").select("doc_id", "text", "found").mapInArrow(
        cut, "doc_id long, n_sentences long, n_removed long, removed array<array<long>>, text string")


def sentences(text: str, part_words: int = 8) -> list[str]:
    """Parts that together are the text; none of a text without words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts = Parts.of(data, np.array([0, len(data)]), part_words)
    edges = np.append(parts.bytes_of(), len(data)).tolist()
    return [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:], strict=False)]
