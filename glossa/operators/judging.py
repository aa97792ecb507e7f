"""Briefs for a rewrite, and the verdict on candidates: meaning, score, severity, economy, grade.

Everything is over tables of texts: a brief is one row a document, a verdict one row a pair. Scores and counts of
both sides come from one analysis of their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators import analysis as A
from glossa.operators import claims as C
from glossa.operators import meaning as M
from glossa.operators import readability as R
from glossa.operators import scoring as S
from glossa.sources.profiles import Profile

MOST_EXCERPT = 240


def allowed_words(words: Column, profile: Profile) -> Column:
    """Readable words a rewrite may have: the larger of the two budgets on top of the source's."""
    policy = profile.rewrite_policy
    return words + F.greatest(F.lit(int(policy["max_readable_word_growth_absolute"])), F.ceil(words * policy["max_readable_word_growth_percent"] / 100))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """A finding's text, cut with a mark where it is long."""
    whole = F.substr(text, start + 1, end - start)
    return F.when(F.length(whole) <= MOST_EXCERPT, whole).otherwise(F.concat(F.substr(whole, F.lit(1), F.lit(MOST_EXCERPT - 1)), F.lit("…")))


def measured(docs: DataFrame, profile: Profile, key: str = "doc_id") -> DataFrame:
    """(key, value, band, words, high, findings): score, readable words and rules of high severity of each text."""
    rows = A.analyze(docs.withColumnRenamed(key, "doc_id"), profile, ["doc_id"])
    high = F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"] == "high"), lambda f: f["rule_id"])))
    of = lambda d: F.filter("findings", lambda f: f["dimension"] == d)
    points = {d: F.round(F.aggregate(of(d), F.lit(0.0), lambda n, f: n + f["penalty"]), 2) for d in profile.weights}
    value = sum((F.round(S.raw_score(points[d]) * w / 100, 2) for d, w in profile.weights.items()), F.lit(0.0))
    out = rows.select(F.col("doc_id").alias(key), F.round(value, 2).alias("value"), F.col("n_words").alias("words"), high.alias("high"), "findings")
    return out.withColumn("band", S.band(F.col("value"), profile))


def briefs(docs: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, profile, value, band, source_words, most_words, defects, sha256): what a rewrite is told.

    Defects come by severity, place and rule, each with its excerpt.
    """
    rows = measured(docs.select("doc_id", "text"), profile).join(docs.select("doc_id", "text"), "doc_id")
    defect = lambda f: F.struct(
        F.when(f["severity"] == "high", 0).when(f["severity"] == "medium", 1).otherwise(2).alias("level"), f["start"].alias("start"), f["rule_id"].alias("rule_id"), f["end"].alias("end"),
        f["dimension"].alias("dimension"), f["severity"].alias("severity"), f["note"].alias("note"), excerpt(F.col("text"), f["start"], f["end"]).alias("excerpt"),
    )
    out = rows.withColumn("defects", F.array_sort(F.transform("findings", defect)))
    out = out.select("doc_id", F.lit(profile.name).alias("profile"), "value", "band", F.col("words").alias("source_words"), allowed_words(F.col("words"), profile).cast("long").alias("most_words"), "defects")
    return out.withColumn("sha256", F.sha2(F.encode(F.to_json(F.struct(*out.columns)), "UTF-8"), 256))


def judge(pairs: DataFrame, profile: Profile, target_grade: float | None = None) -> DataFrame:
    """(pair_id, disposition, source_value, candidate_value, accepted, reasons, allowed_words) of (pair_id, source, candidate).

    A candidate must keep the meaning, score higher, add no rule of high severity and stay within the word
    budget. With a target grade it must instead lower the grade to it without scoring less.
    """
    sides = pairs.select("pair_id", F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("candidate"), F.col("candidate"))).alias("side", "text"))
    docs = sides.select(F.struct("pair_id", "side").alias("doc_id"), "text")
    found = measured(docs, profile)
    grades = R.document_grades(docs).select("doc_id", "flesch_kincaid")
    rows = found.join(grades, "doc_id", "left").select("doc_id.pair_id", "doc_id.side", F.struct("value", "words", "high", "flesch_kincaid").alias("x"))
    wide = rows.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "source", F.col("x"))).alias("a"), F.max(F.when(F.col("side") == "candidate", F.col("x"))).alias("b"))
    joined = wide.join(C.compare_texts(pairs).select("pair_id", "disposition"), "pair_id")
    flat = joined.select(
        "pair_id", "disposition", F.col("a.value").alias("source_value"), F.col("b.value").alias("candidate_value"), F.col("a.words").alias("source_words"), F.col("b.words").alias("candidate_words"),
        F.col("a.high").alias("source_high"), F.col("b.high").alias("candidate_high"), F.col("a.flesch_kincaid").alias("source_grade"), F.col("b.flesch_kincaid").alias("candidate_grade"),
    )
    policy = profile.rewrite_policy
    verdict = M.judged(flat, policy["max_readable_word_growth_percent"], int(policy["max_readable_word_growth_absolute"]), target_grade)
    return verdict.join(flat.select("pair_id", "disposition", "source_value", "candidate_value", "source_grade", "candidate_grade"), "pair_id")


def improve(attempts: DataFrame, profile: Profile, most: int = 3, target_grade: float | None = None) -> DataFrame:
    """(source_id, attempts, accepted_index, -1 for none) of (source_id, index, source, candidate): the first accepted one ends the loop."""
    tried = attempts.filter(F.col("index") < most)
    pairs = tried.select(F.struct("source_id", "index").alias("pair_id"), "source", "candidate")
    verdicts = judge(pairs, profile, target_grade).select("pair_id.source_id", "pair_id.index", "accepted")
    return M.first_accepted(verdicts, most)
