"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written
as Parquet and reread as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import near_copies, packing, quality_classifier, quality_rules
from glossa.llm.common import materialize, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and its group's adaptive thresholds accept."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose calibrated quality is at least one half; learns from the labels of what is left."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies: five-word similarity of 0.8 and more, verified."""
    return near_copies.keep_first(docs)


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", simhash_near_dedup_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

#: The classifier, the fingerprints and the packing are beyond SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
