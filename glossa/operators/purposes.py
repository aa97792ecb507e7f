"""Rules on what sentences are for: mixed purposes and recommendations given twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators.findings import lemma
from glossa.sources import profiles as P

#: What makes a sentence a directive.
DIRECTIVES = ["must", "shall", "should"]


def lemma_array(sentence: Column) -> Column:
    return F.transform(F.transform(X.words(sentence), F.lower), lemma)


def mixed_purposes(sent: DataFrame, profile: P.Profile | None = None) -> DataFrame:
    """(doc_id, sentence_index, n, labels, penalty) of sentences with more purposes than the policy allows."""
    profile = profile or P.load_profile()
    most = int(profile.thresholds["max_sentence_purposes"])
    line = F.concat(F.lit(" "), F.array_join(lemma_array(F.col("sentence")), " "), F.lit(" "))
    labels = F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.col("line").contains(f" {m} ") for m in ms]), k) for k, ms in sorted(profile.phrases("purpose_markers").items())]))
    rows = sent.withColumn("line", line).select("doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), labels.alias("labels"))
    n = F.size("labels")
    return rows.filter(n > most).select("doc_id", "sentence_index", n.alias("n"), F.array_join("labels", ", ").alias("labels"), F.least(F.lit(14.0), (n - most) * 4.0).alias("penalty"))


def duplicated_recommendations(sent: DataFrame, profile: P.Profile | None = None) -> DataFrame:
    """(doc_id, sentence_index, earlier, action_group): directives that repeat an earlier one's action and a term.

    Equi-joined on (document, action group, shared term); the earliest match of each sentence counts.
    """
    action_groups = (profile or P.load_profile()).phrases("recommendation_action_groups")
    rows = sent.withColumn("w", lemma_array(F.col("sentence"))).filter(F.arrays_overlap("w", F.array(*map(F.lit, DIRECTIVES))))
    groups = F.explode(F.array_compact(F.array(*[F.when(F.arrays_overlap("w", F.array(*map(F.lit, vs))), k) for k, vs in sorted(action_groups.items())])))
    known = [v for vs in action_groups.values() for v in vs] + P.STOP_LEMMAS
    terms = F.array_distinct(F.filter("w", lambda x: (F.length(x) >= 5) & ~x.isin(known + DIRECTIVES)))
    keyed = rows.select("doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), groups.alias("action_group"), terms.alias("terms"))
    keyed = keyed.select("doc_id", "sentence_index", "action_group", F.explode("terms").alias("term"))
    first = keyed.groupBy("doc_id", "action_group", "term").agg(F.min("sentence_index").alias("earlier"))
    pairs = keyed.join(first, ["doc_id", "action_group", "term"]).filter("earlier < sentence_index")
    return pairs.groupBy("doc_id", "sentence_index").agg(F.min(F.struct("earlier", "action_group")).alias("x")).select("doc_id", "sentence_index", "x.*")
