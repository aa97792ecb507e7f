"""All rules over one reading: labelled texts, profiles of their own, code, odd rows."""

import json

import pytest

from glossa.operators import analysis as A
from glossa.operators.reading import reading, sentence_spans
from glossa.plans import fixture
from glossa.sources import profiles as P
from glossa.sources.policies import POLICIES

USUAL = P.load_profile()


def found(spark, texts, profile=USUAL):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.rule_id[5:-4], (texts[r.doc_id] or "")[r.start : r.end]) for r in A.findings(docs, profile).collect())


def test_every_rule_is_reached(spark):
    keys = sorted(fixture.TEXTS)
    got = found(spark, [fixture.TEXTS[k] for k in keys])
    assert [(keys[i], rule, text) for i, rule, text in got] == sorted(fixture.EXPECTED)
    assert len({rule for _, rule, _ in fixture.EXPECTED}) == 24


def test_profiles_have_words_of_their_own(spark):
    texts = ["Our synergy is here.", "The market should build the tool. They said so.", "Own the incident process.", "We led the change.\n\n- We improved systems\n- We improved systems\n- We improved systems"]
    strategy, resume = found(spark, texts, P.load_profile("product-strategy")), found(spark, texts, P.load_profile("resume-review"))
    assert (0, "JARGON", "synergy") in strategy and (0, "JARGON", "synergy") not in resume
    assert any(i == 1 and rule == "ACTOR" for i, rule, _ in strategy)
    assert not any(i == 2 and rule == "ACTOR" for i, rule, _ in resume)
    assert any(rule == "REDUNDANCY" for _, rule, _ in resume) and not any(rule == "REDUNDANCY" for _, rule, _ in strategy)


def test_odd_texts(spark):
    got = found(spark, [None, "", "  \n ", "```\nmust be approved\n```", "日本語。", "\\", "(", "The plan must be approved. " * 3000])
    assert {i for i, _, _ in got} == {7} and sum(rule == "PASSIVE" for _, rule, _ in got) == 3000
    assert found(spark, []) == []


def test_reading_places():
    text = "# Title here\n\n- See Dr. Who, e.g. `now.` Then go!\n  More\n\n> quoted"
    got = reading(text)
    for s in got["sentences"]:
        assert text[s["start"] : s["end"]].split() == s["text"].split()
        assert all(text[t["start"] : t["end"]] == t["text"] for t in s["tokens"])
    assert [s["text"] for s in got["sentences"]] == ["Title here", "See Dr. Who, e.g. `now.` Then go!", "More", "quoted"]
    assert sentence_spans("a. b", 0, 4) == [(0, 2), (3, 4)] and sentence_spans("   ", 0, 3) == []


def test_profile_files(tmp_path):
    whole = {"name": "mine", **POLICIES["web-copy"], "bands": [{"name": n, "minimum": lo, "maximum": hi} for n, lo, hi in POLICIES["web-copy"]["bands"]]}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(whole))
    mine = P.read_profile(str(path))
    assert mine.name == "mine" and mine.rules == P.load_profile("web-copy").rules and mine.digest != P.load_profile("web-copy").digest
    for broken in ({"weights": {**whole["weights"], "agency": 1}}, {"rules": {**whole["rules"], "jargon": {"x": [1]}}}, {"bands": [("a", 0, 50), ("b", 60, 100)]}, {"thresholds": {}}):
        path.write_text(json.dumps({**whole, **broken}))
        with pytest.raises(ValueError):
            P.read_profile(str(path))
