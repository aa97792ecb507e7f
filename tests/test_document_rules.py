"""Rules over tokens and purposes on whole documents, and noun stacks of any length."""

import pytest

from glossa.operators import dependencies as D
from glossa.plans import catalogue

TEXT = "The decision must be approved. The team must fix the outage. They shall remediate outage causes and confirm the decision before the gate opens."


@pytest.mark.parametrize(
    "name", ["r2_r3_document_sentence_loads", "r9_document_agentless_decisions", "r10_document_passive_verbs", "r19_document_mixed_purposes", "r22_document_duplicated_recommendations"]
)
def test_rules_read_documents(spark, tmp_path, name):
    spark.createDataFrame([(7, TEXT, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == {7}


def test_noun_stacks_have_no_longest(spark):
    rows = [(1, 0, k, f"w{k}", f"w{k}", "NOUN", "compound", 20) for k in range(20)] + [(1, 0, 20, "head", "head", "NOUN", "ROOT", 20)]
    tokens = spark.createDataFrame(rows, "doc_id int, sentence_index int, index int, text string, lemma string, pos string, dep string, head int")
    assert [(r.root, r.depth) for r in D.noun_stacks(tokens).collect()] == [(20, 21)]


def test_subtrees_of_deep_chains(spark):
    rows = [(1, 0, k, max(k - 1, 0)) for k in range(150)] + [(1, 1, 150, 150), (1, 1, 151, 999)]
    got = D.subtree(spark.createDataFrame(rows, "doc_id int, sentence_index int, index int, head int")).collect()
    assert len(got) == 150 * 151 // 2 + 2 and {r["index"] for r in got if r.root == 100} == set(range(100, 150))
