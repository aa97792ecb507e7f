"""All finding rules over each document, with places in the text.

A document is one row and stays one: an analysis is one scan and one Python step, in which a text is read once and
only its findings come back, and no shuffle. The rules are in ``rules``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.reading import OUTLINE, by_text, by_texts, outline
from glossa.operators.rules import Rules
from glossa.sources.profiles import Profile

FINDING = "struct<rule_id: string, dimension: string, severity: string, start: int, end: int, sentence_index: int, observed: double, threshold: double, penalty: double, note: string>"
FOUND = f"struct<n_words: int, findings: array<{FINDING}>>"


def _finder(profile: Profile) -> Callable[[list[str], pa.DataType], pa.Array]:
    """Texts to ``FOUND``, built by columns."""
    made: list[Rules] = []  # in the worker: one for all its parts

    def find(texts: list[str], kind: pa.DataType) -> pa.Array:
        if not made:
            made.append(Rules(profile))
        counts, ends, rows = [], [0], []
        for text in texts:
            n_words, found = made[0].text(text)
            rows += found
            counts.append(n_words)
            ends.append(len(rows))
        each = kind.field("findings").type
        fields = list(each.value_type)
        columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
        findings = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), findings, type=each)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), lists], fields=list(kind))

    return find


def analyze(docs: DataFrame, profile: Profile, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``findings`` (in order of place) of each document, one row each."""
    rows = docs.select(*keep, by_texts(_finder(profile), FOUND, F.col("text")).alias("found"))
    return rows.select(*keep, "found.n_words", "found.findings")


def findings(docs: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id and the fields of ``FINDING``): all rules but the grade rule, which only policies with ``max_grade`` have."""
    return analyze(docs, profile, ["doc_id"]).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


def sentence_records(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, block_index, start, end, words) of every sentence."""
    rows = docs.select("doc_id", F.explode(by_text(outline, OUTLINE, F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.index").alias("sentence_index"), F.col("s.block").alias("block_index"), "s.start", "s.end", F.col("s.n_words").alias("words"))
