"""Each stage of the pipeline against brute force that uses no operator, on rows with nulls, repeats and clashing names."""

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.queries import tokenizer_path

from .test_text_operators import _buckets, _contamination, _line_dedup, _shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "keys", "n_lines", "n_dropped", "_row", "whole", "words", "spans"]
SCHEMA = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS)


@pytest.fixture(scope="module")
def rows(corpus):
    """The corpus with languages, ties, repeated rows and a column for each name that the operators use."""
    out = [(d, t, ("en", "fr", None)[i % 3], "s", len(t or ""), *[f"{c} {i}" for c in COLUMNS[5:]]) for i, (d, t) in enumerate(corpus)]
    return out + [out[8], out[8], (None, None, *out[8][2:]), (None, out[7][1], *out[7][2:])]


@pytest.fixture(scope="module")
def folder(spark, rows, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, dict(corpus)[300]), (2, "One two"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none.parquet")
    return str(path)


def _ran(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/none.parquet"), folder).count() == 0
    return collections.Counter(map(str, map(tuple, out.collect())))


def _bag(rows):
    return collections.Counter(map(str, rows))


def test_language_id(spark, folder, rows):
    counts = {k: collections.Counter() for k in ("en", "fr")}
    for d, t, k, *_ in rows:
        if t is not None and k and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            counts[k].update(_buckets(t, (1, 2, 3), 15))
    logp = {k: {b: np.log(np.float32((n + 0.5) / (c.total() + 0.5 * 2**15))) for b, n in c.items()} | {None: np.log((0.5) / (c.total() + 0.5 * 2**15))} for k, c in counts.items()}
    want, close = [], set()
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            sums = {k: sum(logp[k].get(b, logp[k][None]) for b in _buckets(r[1], (1, 2, 3), 15)) for k in logp}
            if abs(sums["en"] - sums["fr"]) < 1e-3 * len(r[1]):
                close.add(r[5:])
            want.append((*r[:2], max(sorted(sums), key=lambda k: sums[k]), *r[3:]))
    found = _ran(spark, folder, "language_id")
    same = lambda bag: collections.Counter({x: n for x, n in bag.items() if not any(str(c)[1:-1] in x for c in close)})
    assert same(found) == same(_bag(want)) and found.total() == len(want)


def test_line_dedup(spark, folder, rows):
    kept = _line_dedup([r[:2] for r in rows])
    want = [(r[0], t, *r[2:4], len(t), *r[5:]) for r, (_, n, gone, t) in zip(rows, kept, strict=True) if gone < n]
    assert _ran(spark, folder, "line_dedup") == _bag(want)


def test_near_duplicates(spark, folder, rows):
    sets = [_shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    members = collections.defaultdict(list)
    for k, g in enumerate(group):
        members[g if sets[k] else -1 - k].append(rows[k])
    found = _ran(spark, folder, "near_duplicates")
    assert found.total() == len(members)
    for rows_of in members.values():  # of rows that share the smallest id any may stay
        least = min((r[0] is None, r[0] or 0) for r in rows_of)
        assert any(found[str(r)] for r in rows_of if (r[0] is None, r[0] or 0) == least)


def test_decontamination(spark, folder, rows, corpus):
    items = [(1, dict(corpus)[300]), (2, "One two"), (3, None)]
    hit = [x[5] for x in _contamination([r[:2] for r in rows], items, 10)]
    assert _ran(spark, folder, "decontamination") == _bag([r for r, h in zip(rows, hit, strict=True) if not h])


def test_packing(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.packed(spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for d, t, *_ in rows:
        want[d] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for r in found:
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
