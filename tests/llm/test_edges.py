"""Cases that every operator meets: clashing names, repeated and null ids, ties, long texts, and scans cut another way."""

import collections

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, common, decontam, jaccard, langid, lines, packing, spans, suffix, warc
from tidemark.llm.queries import tokenizer_path

CLASHES = ["_row", "row", "h", "core", "full", "lo", "n", "key", "node", "component", "shingle", "words", "found", "text_a", "rank", "score", "cell", "sha", "size", "refers", "record", "place", "a", "b", "kept", "keys", "_path", "_at", "_file"]


@pytest.fixture(scope="module")
def clashing(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    docs.select("doc_id", "text", "lang", *[F.lit(c).alias(c) for c in CLASHES]).write.parquet(path)
    return spark.read.parquet(path)


def _bag(df):
    return collections.Counter(map(str, df.collect()))


@pytest.mark.parametrize("apply", [
    lambda d: jaccard.components(d), lambda d: suffix.dedup_bytes(d, length=90, gram=16).drop("kept"), lambda d: lines.LineIndex.build(d).apply(d),
    lambda d: decontam.report(d, d.where("doc_id = 300").select(F.col("doc_id").alias("item_id"), "text")),
    lambda d: langid.LanguageModel.fit(d.where("doc_id % 4 <> 2")).predict(d).select("doc_id", "lang_pred", F.round("score", 6)),
    lambda d: packing.pack_documents(d, tokenizer_path()).groupBy("doc_id").agg(F.sum("length")), lambda d: spans.dedup_spans(d).agg(F.sum("n_sentences"))])
def test_other_columns_change_nothing(docs, clashing, apply):
    assert _bag(apply(clashing)) == _bag(apply(docs.select("doc_id", "text", "lang")))


def test_other_columns_of_pages_vectors_and_turns(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else f"x{i}") for i in range(6)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(30)], "vec_id long, embedding array<double>")
    turns = spark.createDataFrame([(i // 2, i % 2, "u", f"t{i}") for i in range(8)], "conv_id long, turn long, role string, text string")
    more = [F.lit(c).alias(c) for c in CLASHES]
    assert _bag(warc.read_archive(warc.write_archive(pages.select("*", *more)))) == _bag(warc.read_archive(warc.write_archive(pages)))
    assert _bag(ann.search(vectors.select("*", *more), vectors.where("vec_id < 3"), k=2)) == _bag(ann.search(vectors, vectors.where("vec_id < 3"), k=2))
    assert _bag(chat.collapse_and_render(turns.select("*", *more))) == _bag(chat.collapse_and_render(turns))


def test_row_numbers_hold_whatever_cuts_the_scan(spark, docs):
    """As when an executor is lost or added between two scans: files are cut in other pieces."""
    before = _bag(common.with_row_id(docs).select("_row", "doc_id", F.md5("text")))
    with_filter = common.with_row_id(docs.where("doc_id > 100")).select("_row", "doc_id", F.md5("text"))
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "13"}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        assert _bag(common.with_row_id(docs).select("_row", "doc_id", F.md5("text"))) == before
        assert not _bag(with_filter) - before
        found = _bag(jaccard.components(docs))
    finally:
        for k, x in old.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
    assert found == _bag(jaccard.components(docs))
    joined = docs.select("doc_id", "text").join(spark.range(3), F.col("doc_id") == F.col("id"))  # no scan: written once
    rows = common.with_row_id(joined)
    assert _bag(rows) == _bag(rows) and rows.select("_row").distinct().count() == joined.count()


def test_long_texts_cross_groups(spark, tmp_path):
    """Texts around and beyond the size that tasks take at once, with a copy each."""
    texts = [" ".join(f"{p}{i}" for i in range(n)) + "." for p, n in (("a", 30), ("b", 200_000), ("c", 60_000))]
    path = str(tmp_path / "long")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()) == [(i, i % 3) for i in range(6)]
    gone = {r.doc_id: r.n_removed for r in spans.dedup_spans(docs).collect()}
    assert [gone[i] for i in range(3)] == [0, 0, 0] and all(gone[3 + i] == len(spans.sentences(texts[i])) for i in range(3))
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.dedup_bytes(docs).collect()}
    assert all(found[i] == (len(texts[i % 3]),) * 2 if len(texts[i % 3]) >= 200 else found[i][1] == 0 for i in range(6))
