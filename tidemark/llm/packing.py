"""Sequence packing as vector bin packing. A sequence (bin) has limits on tokens, on segments and on loss-bearing
tokens; an example (item) has a size in each. Bins are filled one after another: of the items at hand that fit, the
one whose sizes have the largest dot product with the bin's remaining room (both as shares of the limits, weighted
by how scarce each resource is among the items at hand) goes in. When none fits whole, one is cut.

Each task packs the examples of its own input partition and holds a bounded pool of them, so nothing is shuffled.
A sequence id holds the partition's number in its upper bits; a retried task makes the same sequences again.

Defined cases: null text is empty, so the document is its end token alone; repeated or null ids are documents of
their own; an example without tokens makes no piece; other columns are ignored. A single example larger than a limit
is cut into pieces that keep it.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _spellings() -> list[str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_SPELLED = _spellings()


class WordTokenizer:
    """Ids of a lower-casing vocabulary whose pre-tokens never hold white space, so that the ids of a text are those of
    its chunks between blanks in turn. Chunks seen before come from a cache of two generations: when the young one
    has ``size`` chunks it becomes the old one, from which chunks that come again return."""

    #: Beyond these, lower case may depend on neighbours or on composition; such texts are left to the tokenizer.
    BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")
    TAILS = ".,!?;:"
    #: What special tokens start with: texts that hold it go to the tokenizer whole.
    SPECIAL = "<|"

    def __init__(self, path: str, size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size = size

    def _look_up(self, chunks: set[str]) -> None:
        """Puts the ids of all chunks into the young generation."""
        new = []
        for c in chunks:
            if (known := self.old.get(c)) is not None:
                self.young[c] = known
            else:
                new.append(c)
        # letters followed by marks are two pre-tokens: many chunks, few words
        for c in new:
            w = c.rstrip(self.TAILS)
            if w.isalpha() and not self.BEYOND.search(w) and w == w.lower():
                self.young[c] = self._word(w) + (self._other(c[len(w) :]) if len(w) < len(c) else b"")
            else:
                self.young[c] = self._other(c)

    def _word(self, w: str) -> bytes:
        """A lower-case word of letters is one pre-token and needs the merges alone."""
        if (known := self.young.get(w)) is None:
            if (known := self.old.get(w)) is None:
                spelled = w if w.isascii() else "".join(map(_SPELLED.__getitem__, w.encode()))
                known = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            self.young[w] = known
        return known

    def _other(self, c: str) -> bytes:
        if (known := self.young.get(c)) is None:
            known = self.young[c] = array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes()
        return known

    def ids(self, text: str) -> np.ndarray:
        """As ``tokenizers`` gives them without adding tokens: special tokens that stand in a text are themselves."""
        if self.SPECIAL in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if not self.BEYOND.search(text):
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        if len(self.young) > self.size:
            self.old, self.young = self.young, {"": b""}
        if missing := set(chunks).difference(self.young):
            self._look_up(missing)
        return np.frombuffer(b"".join(map(self.young.__getitem__, chunks)), "<u4")


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker: its cache serves the worker's later tasks too."""
    return WordTokenizer(path)


class Packer:
    """Packs items (key, number of tokens, loss mask, first place with loss, or None) into sequences; yields pieces
    (key, start, length, loss, sequence, offset). Holds at most ``pool`` items and one open sequence."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int, first_sequence: int = 0):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.int64)
        self.pool = pool
        self.next = first_sequence
        self.items: list[tuple] = []  # (key, start, loss-bearing tokens before each place, or where loss begins, or None: all bear loss)
        self.sizes = np.empty((0, 3), np.int64)
        self.leads = np.empty(0, np.int64)  # tokens without loss at an item's start
        self.open: list[tuple] = []  # (key, start, length, loss sums)
        self.room = self.limits.copy()

    @staticmethod
    def _loss(sums, start: int, length: int) -> int:
        if isinstance(sums, int):
            return max(0, start + length - max(start, sums))
        return length if sums is None else int(sums[start + length] - sums[start])

    def _longest(self, sums, start: int, n: int, room: np.ndarray) -> int:
        """Of n tokens from start, how many fit."""
        n = int(min(n, room[0]))
        if room[1] < 1 or n < 1:
            return 0
        if sums is None:
            return int(min(n, room[2]))
        if isinstance(sums, int):
            return int(min(n, max(0, sums - start) + room[2]))
        return int(min(n, np.searchsorted(sums, sums[start] + room[2], "right") - 1 - start))

    def _keep(self, key, start: int, n: int, sums) -> None:
        self.items.append((key, start, sums))
        self.sizes = np.vstack([self.sizes, [[n, 1, self._loss(sums, start, n)]]])
        self.leads = np.append(self.leads, self._lead(sums, start, n))

    @staticmethod
    def _lead(sums, start: int, n: int) -> int:
        if isinstance(sums, int):
            return max(0, min(n, sums - start))
        return 0 if sums is None else int(min(n, np.searchsorted(sums, sums[start], "right") - 1 - start))

    def _placed(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length, sums in pieces:
            yield (key, start, length, self._loss(sums, start, length), self.next, offset)
            offset += length
        self.next += 1

    def add(self, key, n: int, loss: np.ndarray | int | None = None) -> Iterator[tuple]:
        """``loss``: which tokens bear it, or the place from which on all do; null: all."""
        sums = loss if loss is None or isinstance(loss, int) else np.concatenate(([0], np.cumsum(loss))).astype(np.int64)
        start = 0
        while start < n:
            take = self._longest(sums, start, n - start, self.limits)
            if take == self.limits[0]:
                yield from self._placed([(key, start, take, sums)])
            else:
                self._keep(key, start, take, sums)
            start += take
        while len(self.items) > self.pool:
            yield from self._step()

    def _step(self) -> Iterator[tuple]:
        """Puts one item, or as much of one as fits, into the open sequence; closes that when it is full."""
        fits = (self.sizes <= self.room).all(axis=1)
        if fits.any():
            shares = self.sizes / self.limits
            score = (shares * (self.room / self.limits) * shares.mean(axis=0)).sum(axis=1)
            k = int(np.where(fits, score, -1.0).argmax())
            take = int(self.sizes[k, 0])
        else:
            begun = np.minimum(np.minimum(self.sizes[:, 0], self.room[0]), self.leads + self.room[2])  # of each the start that fits
            k = int(np.lexsort((-self.sizes[:, 0], -begun))[0])
            take = self._longest(self.items[k][2], self.items[k][1], int(self.sizes[k, 0]), self.room)
        if take:
            key, start, sums = self.items[k]
            loss = self._loss(sums, start, take)
            self.open.append((key, start, take, sums))
            self.room -= [take, 1, loss]
            if take < self.sizes[k, 0]:
                self.items[k] = (key, start + take, sums)
                self.sizes[k] -= [take, 0, loss]
                self.leads[k] = self._lead(sums, start + take, int(self.sizes[k, 0]))
            else:
                self.items[k] = self.items[-1]
                self.sizes[k] = self.sizes[-1]
                self.items.pop()
                self.sizes = self.sizes[:-1]
                self.leads[k] = self.leads[-1]
                self.leads = self.leads[:-1]
        if not take or self.room[0] == 0 or self.room[1] == 0:
            pieces, self.open, self.room = self.open, [], self.limits.copy()
            yield from self._closed(pieces)

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A sequence that is full; of one that a limit has closed before, what fills a power of two. The rest goes back."""
        left = sum(p[2] for p in pieces)
        left = left if left == self.limits[0] else 1 << (left.bit_length() - 1)
        full = []
        for key, start, length, sums in pieces:
            if take := min(length, left):
                full.append((key, start, take, sums))
            if take < length:
                self._keep(key, start + take, length - take, sums)
            left -= take
        yield from self._placed(full)

    def finish(self) -> Iterator[tuple]:
        """The rest. What the last sequence holds is cut into parts of power-of-two lengths, without padding."""
        while self.items:
            yield from self._step()
        left = sum(p[2] for p in self.open)
        part, room = [], 1 << (left.bit_length() - 1) if left else 0
        for key, start, length, sums in self.open:
            while length:
                take = min(length, room)
                part.append((key, start, take, sums))
                start, length, room, left = start + take, length - take, room - take, left - take
                if not room:
                    yield from self._placed(part)
                    part, room = [], 1 << (left.bit_length() - 1) if left else 0
        self.open, self.room = [], self.limits.copy()


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, max_segments: int = 64,
                   max_loss: int | None = None, end_id: int = 2, pool: int = 256, prompt_share: float = 0.0,
                   doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents (``PIECES``). ``prompt_share``: the leading share of a document's tokens that bears
    no loss (0: all tokens do), for instruction data whose answers follow their prompts."""
    max_loss = max_loss or max_tokens

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, pool, TaskContext.get().partitionId() << 40)
        ids_of: dict[int, tuple] = {}
        number, rows = 0, []

        def row(piece):
            key, start, length, loss, sequence, offset = piece
            d, ids, left = ids_of[key]
            rows.append((d, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset, loss))
            ids_of[key] = (d, ids, left - length)
            if left == length:
                del ids_of[key]

        def batch_of():
            out = pa.Table.from_pandas(pd.DataFrame(rows, columns=names), schema=schema, preserve_index=False).to_batches() if rows else []
            rows.clear()
            return out

        names = [x.split()[0] for x in PIECES.split(", ")]
        schema = pa.schema([(n, pa.int64()) for n in names])
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenizer.ids(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                ids_of[number] = (d, ids, len(ids))
                loss = None if not prompt_share else int(prompt_share * len(ids))
                for piece in packer.add(number, len(ids), loss):
                    row(piece)
                number += 1
            yield from batch_of()
        for piece in packer.finish():
            row(piece)
        yield from batch_of()

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, PIECES)
