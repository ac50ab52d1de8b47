"""Language identification: multinomial naive Bayes over hashed character n-grams. Counts of a bounded sample of
labelled texts become a matrix of log probabilities (buckets x languages) that is broadcast. Texts are scored in sparse
batches: the bucket numbers of many texts together pick rows of the matrix, which are summed text by text, and a long
text is passed over in steps that carry the code points between them.

Defined cases: a text that is null or has no letter (``str.isalpha``, Unicode categories L) is ``und`` with score 0; ties go to the language that sorts
first; rows without a label teach nothing; without any labelled row every text is ``und``; repeated or null ids are
rows of their own, and a null id is never held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
STEP = 1 << 15  # code points that are scored at once


def points_of(text: str) -> np.ndarray:
    """Code points of a text in lower case, each blank run one blank, and one at both ends."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_buckets(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket numbers of the n-grams at all places) for each order n: g = 0; for each code point p: g = (g + p) * A,
    g ^= g >> 15; then (g + n) * B, of which the upper ``bits`` bits count. 32-bit arithmetic."""
    grams = np.zeros(len(points), np.uint32)
    for n in range(1, min(max(orders), len(points)) + 1):
        grams = (grams[: len(points) - n + 1] + points[n - 1 :]) * np.uint32(0x9E3779B1)
        grams ^= grams >> np.uint32(15)
        if n in orders:
            yield n, ((grams + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    orders: tuple[int, ...]
    bits: int

    @classmethod
    def fit(cls, rows: DataFrame, docs_per_language: int = 4000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15,
            smoothing: float = 0.5, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
        """Learns from about ``docs_per_language`` whole texts of each language (all, if there are fewer), chosen by
        a hash of ``key``: the bound of the sample. Counting is spread; the driver gets languages x buckets counts."""
        rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
        languages = sorted(sizes)
        if not languages:
            return cls([], np.zeros((1 << bits, 0), np.float32), orders, bits)
        share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
        place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.where(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(languages), 1 << bits), np.int64)
            for batch in batches:
                for name, body in zip(batch["lang"], batch["text"], strict=True):
                    for _, found in gram_buckets(points_of(body), orders, bits):
                        total[languages.index(name)] += np.bincount(found, minlength=1 << bits)
            which, bucket = np.nonzero(total)
            yield pd.DataFrame({"which": which, "bucket": bucket, "n": total[which, bucket]})

        counts = np.full((1 << bits, len(languages)), smoothing)
        found = sample.mapInPandas(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[found["bucket"], found["which"]] += found["n"]
        return cls(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), orders, bits)

    def predict(self, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """The kept columns of every row, with lang_pred and score (or other ``names``), the posterior of that language
        (equal priors)."""
        model = docs.sparkSession.sparkContext.broadcast(self)
        schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(names[0], "string").add(names[1], "double")

        at = keep.index(text) if text in keep else len(keep)  # a kept text travels once

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = model.value.best(t.as_py() for t in batch.column(at))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(len(keep))), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [*keep, names[0], names[1]])

        more = [] if text in keep else [F.col(f"`{text}`").alias("_text_to_score")]
        return docs.select(*[F.col(f"`{c}`") for c in keep], *more).mapInArrow(score, schema)

    @cached_property
    def _columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.log_probability.T, np.float64)

    def best(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for text in texts:
            out.append((UNKNOWN, 0.0))
            if self.languages and text and any(map(str.isalpha, text)):
                group.append((len(out) - 1, points_of(text)))
                held += len(group[-1][1])
                if held >= STEP:
                    self._score(group, out)
                    group, held = [], 0
        self._score(group, out)
        return out

    def _score(self, group: list[tuple[int, np.ndarray]], out: list[tuple[str, float]]) -> None:
        """One pass over the joined code points in steps; n-grams that reach into the next text are left out."""
        if not group:
            return
        points = np.concatenate([p for _, p in group])
        ends = np.cumsum([len(p) for _, p in group])
        total = np.zeros((len(group), len(self.languages)))
        for at in range(0, len(points), STEP):
            part = points[at : at + STEP + max(self.orders) - 1]
            for n, buckets in gram_buckets(part, self.orders, self.bits):
                places = np.arange(at, at + min(len(buckets), STEP))
                which = np.searchsorted(ends, places, "right")
                inside = places + n <= ends[which]
                which, some = which[inside], buckets[: len(places)][inside]
                if len(which):
                    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                    for k, column in enumerate(self._columns):
                        total[which[first], k] += np.add.reduceat(column[some], first)
        for (k, _), row in zip(group, total, strict=True):
            share = np.exp(row - row.max())
            out[k] = self.languages[int(row.argmax())], float(share.max() / share.sum())


def held_out(doc: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(4)) == 2, F.lit(False))


def accuracy(predicted: DataFrame, labelled: DataFrame, by: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Documents and the share predicted right, for held-out rows and the others."""
    rows = predicted.join(labelled.select(by, F.col(lang).alias("_truth")).where("_truth is not null"), by)
    return rows.groupBy("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("_truth")).cast("double")).alias("accuracy"))
