"""Readability grades of sentences and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X

_COUNTS = X.COUNTS
#: What readability does not read, in order, and what stands for it.
NOT_READ = [
    ("`[^`\n]+`", " "),
    (r"!?\[([^\]\n]*)\]\([^()\s]*\)", "$1"),
    (r"https?://[^\s<>()]+", " "),
    (r"\[[A-Za-z0-9_.:-]+\]|\([A-Za-z][A-Za-z .'-]+,\s*\d{4}\)|\(pp?\.\s*\d+(?:[-–]\d+)?\)", " "),
]


def readable(docs: DataFrame) -> DataFrame:
    """``docs`` whose text has no inline code, link targets, addresses and citations; a link's label stays."""
    text = F.col("text")
    for pattern, left in NOT_READ:
        text = F.regexp_replace(text, pattern, left)
    return docs.withColumn("text", text)


def sentence_counts(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """(doc_id, sentence_index, counts) of sentences that have a word; words stay arrays, nothing is shuffled."""
    rows = X.sentences(docs, ["doc_id"]).select("doc_id", "sentence_index", X.words(F.col("sentence")).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", "sentence_index", X.word_counts(F.col("w"), normalize).alias("n")).select("doc_id", "sentence_index", "n.*")


def sentence_grades(docs: DataFrame) -> DataFrame:
    counts = sentence_counts(docs).withColumn("sentences", F.lit(1).cast("long"))
    return counts.select("doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), *_COUNTS, *[v.alias(k) for k, v in X.grades().items()])


def _document_counts(docs: DataFrame, keep: list[str], normalize: bool) -> DataFrame:
    """``keep`` columns, sentences and counts of each row's text: no row is made for a word or a sentence."""
    said = F.filter(F.transform(X.sentence_array(F.col("text")), X.words), lambda w: F.size(w) > 0)
    rows = docs.select(*keep, said.alias("said")).filter(F.size("said") > 0)
    return rows.select(*keep, F.size("said").cast("long").alias("sentences"), X.word_counts(F.flatten("said"), normalize).alias("n")).select(*keep, "sentences", "n.*")


def document_grades(docs: DataFrame, normalize: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Counts summed over sentences, and the six estimates; documents without a word have no row.

    Rows of one id are one document. Only rows of counts are shuffled, one a document.
    """
    names = ["doc_id", *(keep or [])]
    total = _document_counts(docs, names, normalize).groupBy(*names).agg(*[F.sum(c).alias(c) for c in ["sentences", *_COUNTS]])
    return total.select(*names, "sentences", *_COUNTS, *[v.alias(k) for k, v in X.grades().items()])


def grade_findings(docs: DataFrame, max_grade: float = 8.0, min_words: int = 5) -> DataFrame:
    """Sentences whose grade is over ``max_grade``."""
    over = sentence_grades(docs).filter((F.col("words") >= min_words) & (F.col("flesch_kincaid") > max_grade))
    penalty = F.least(F.lit(15.0), F.round((F.col("flesch_kincaid") - max_grade) * 1.5, 2))
    return over.select(
        "doc_id", "sentence_index", F.lit("LING-GRADE-001").alias("rule_id"), F.lit("sentence_load").alias("dimension"), F.col("flesch_kincaid").alias("observed"),
        X.severity(F.col("flesch_kincaid"), F.lit(max_grade)).alias("severity"), penalty.alias("penalty"),
    )


def grades_by_source(docs: DataFrame) -> DataFrame:
    """Rollup of document grades over (lang, source)."""
    rows = document_grades(docs, keep=["lang", "source"])
    return rows.rollup("lang", "source").agg(
        F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), F.round(F.min("flesch_kincaid"), 2).alias("least_grade"), F.round(F.max("flesch_kincaid"), 2).alias("most_grade")
    )
