"""Forms that read each text once, against the forms over whole tables or whole readings."""

import pyarrow as pa

from glossa.functions import text as X
from glossa.operators import analysis, claims
from glossa.operators.annotate import tokens
from glossa.operators.reading import few, outline, reading

TEXTS = [
    "The platform team must resolve the two gaps. Close the findings and do not open them. They were fixed by the audit team, and Ann's owners should check it!",
    "# Head\n\n- Approve the plan.\n- `x = 1` is _never_ used; see co-op's v1.2.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nThree services cannot deploy before it, or fail. \u00e9t\u00e9\u0301 x_y __ ok.",
    None,
    "",
]


def test_claims_of_sentences_are_those_of_tokens(spark):
    sent = X.sentences(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), ["doc_id"])
    want, got = claims.claims(tokens(sent)), claims.claims_of(sent)
    assert got.schema.simpleString() == want.schema.simpleString() and want.count() > 5
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_outline_is_the_reading_without_tokens(spark):
    for text in TEXTS:
        assert outline(text or "") == [{k: s[k] for k in ("index", "block", "start", "end", "n_words")} for s in reading(text or "")["sentences"]]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert "tokens" not in analysis.sentence_records(docs)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_in_small_parts():
    texts = pa.array(["a" * 60, None, "b" * 500, "", "c" * 60, "d" * 60])
    parts = [p.to_pylist() for p in few(texts, 100)]
    assert sum(parts, []) == texts.to_pylist() and max(len(p) for p in parts) < 6 and ["b" * 500] in [[x for x in p if x] for p in parts]
