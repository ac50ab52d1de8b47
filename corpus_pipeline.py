"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and its result is
written and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, langid, lines, packing
from tidemark.llm.common import table, unused, with_row_id, written
from tidemark.llm.queries import tokenizer_path


def _whole(docs: DataFrame) -> DataFrame:
    """What the operators read, and the other columns as one beside it: no name of a column can clash with theirs, and the
    text travels once."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("whole"))


def _columns(docs: DataFrame, rows: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of ``whole`` and the text, with new values where docs has those columns."""
    of = {"text": F.col("text")} | new
    return rows.select(*[(of[c].cast(t) if c in of else F.col(f"whole.`{c}`")).alias(c) for c, t in docs.dtypes])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go: null and empty texts and those without a letter. lang
    becomes the predicted language. Rows that repeat, or have a null id, are judged each for themselves; ties between
    languages go to the one that sorts first; with no labelled text all go; other columns, whatever their names, stay."""
    model = langid.LanguageModel.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = model.predict(_whole(docs), keep=("whole", "text")).where(F.col("lang_pred") != langid.UNKNOWN)
    return _columns(docs, found, lang=F.col("lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the one of the largest id; a document that loses all of its
    lines goes. Null text is one empty line and becomes empty; rows with a null id are left as they are and count nowhere;
    rows that repeat an id count as one document; other columns, whatever their names, stay."""
    kept = lines.LineIndex.build(docs).apply(_whole(docs), keep=("whole",)).where("n_dropped < n_lines")
    return _columns(docs, kept, n_chars=F.length("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.75 or more, the one of the smallest id stays. Rows count,
    not ids: of rows that share the smallest id the first stays, a row without an id only where its group has none with
    one, and rows that are linked with no other stay whatever their ids; so do all null and empty texts. Other columns,
    whatever their names, stay."""
    rows = with_row_id(docs, name := unused(docs.columns, "_row"))
    stay = jaccard.keepers(rows, row=name).withColumnRenamed("_row", name)
    return rows.join(stay, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all words of a shorter one) go. Null and empty
    texts stay, repeated rows and rows without an id are judged each for themselves, and so are long texts, whole; an
    empty benchmark leaves all; other columns, whatever their names, stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. Null and empty texts are their end token alone,
    repeated and null ids are documents of their own, longer texts are cut; other columns are left out."""
    return packing.pack_documents(docs, tokenizer_path(), max_segments=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language models and vocabularies have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
