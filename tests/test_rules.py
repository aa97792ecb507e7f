"""The finding rules in plain Python: no tokens leave the Python step, and long sentences take time in proportion."""

import time

from glossa.operators import analysis
from glossa.operators.annotate import annotate
from glossa.operators.rules import Rules
from glossa.plans import fixture
from glossa.sources import profiles as P

USUAL = P.load_profile()


def test_findings_leave_python_without_tokens(spark):
    docs = spark.createDataFrame(list(fixture.TEXTS.items()), "doc_id long, text string")
    found = analysis.findings(docs, USUAL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan and "lambda" not in plan and "Exchange" not in plan
    rules = Rules(USUAL)
    assert [tuple(r) for r in found.orderBy("doc_id", "start", "end", "rule_id", "note").collect()] == [(k, *f) for k, t in fixture.TEXTS.items() for f in rules.text(t)[1]]


def test_words_that_end_in_a_conjunction_do_not_part_items():
    listed = lambda text: [f for f in Rules(USUAL).text(text)[1] if f[0] == "LING-LIST-001"]
    assert listed("We test one, two, three, four and five.")[0][6] == 5.0
    assert listed("We test one, two, three, four²and five.") == []


def test_noun_stacks_of_any_threshold():
    text = "The platform service account access policy applies."
    for least, found in ((1, 1), (2, 1), (5, 1), (6, 0)):
        profile = P.Profile(USUAL.name, USUAL.version, USUAL.weights, USUAL.bands, USUAL.thresholds | {"noun_stack_words": least}, USUAL.rules)
        assert sum(f[0] == "LING-NOUN-STACK-001" for f in Rules(profile).text(text)[1]) == found


def test_long_sentences_take_time_in_proportion():
    start = time.process_time()
    tokens = annotate("We make a plan " + "the plan " * 20000 + "we make it")
    assert len(tokens) == 40007 and tokens[-3]["dep"] == "nsubj" and time.process_time() - start < 10
