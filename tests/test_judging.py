"""Briefs, verdicts, the loop over candidates, and the command line."""

import json

import pytest

import glossa
from glossa import cli
from glossa.operators import judging
from glossa.operators import meaning as M
from glossa.sources import profiles as P

USUAL = P.load_profile()
SOURCE = "The authorization gaps must be resolved by the platform team."
BETTER = "The platform team must resolve the authorization gaps."


def test_verdicts(spark):
    pairs = [(1, SOURCE, BETTER), (2, SOURCE, SOURCE), (3, SOURCE, "The platform team must resolve the audit findings."), (4, BETTER, "The team in order to pass must very clearly resolve the authorization gaps. " * 4)]
    df = spark.createDataFrame(pairs, "pair_id int, source string, candidate string")
    got = {r.pair_id: r for r in glossa.judge(df).collect()}
    assert got[1].accepted and got[1].candidate_value > got[1].source_value and got[1].allowed_words == 22
    assert got[2].reasons == "score_not_improved" and got[3].reasons.startswith("meaning_changed")
    assert not got[4].accepted and "too_long" in got[4].reasons


def test_target_grade(spark):
    """With a target the score may stay, but the grade must fall to it."""
    rows = [(1, 80.0, 80.0, 9.0, 7.0), (2, 80.0, 79.0, 9.0, 7.0), (3, 80.0, 90.0, 9.0, 9.0), (4, 80.0, 90.0, 9.0, 8.5), (5, 80.0, 90.0, 9.0, None)]
    schema = "pair_id int, source_value double, candidate_value double, source_grade double, candidate_grade double"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'equivalent' AS disposition", "50 AS source_words", "50 AS candidate_words", "array('A') AS source_high", "array('A') AS candidate_high")
    got = {r.pair_id: r.reasons for r in M.judged(df, target_grade=8.0).collect()}
    assert got == {1: "", 2: "score_regressed", 3: "grade_not_lowered,grade_over_target", 4: "grade_over_target", 5: "grade_not_lowered,grade_over_target"}


def test_briefs(spark):
    row = judging.briefs(spark.createDataFrame([(1, SOURCE + " It is very clearly so. " + "word " * 300)], "doc_id int, text string"), USUAL).first()
    levels = [(d.level, d.start, d.rule_id) for d in row.defects]
    assert levels == sorted(levels) and row.defects[0].severity == "high" and all(len(d.excerpt) <= 240 for d in row.defects)
    assert row.most_words == row.source_words + max(12, -(-row.source_words // 10)) and len(row.sha256) == 64
    assert any(d.excerpt == "must be resolved" and d.rule_id == "LING-PASSIVE-001" for d in row.defects)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    source, better, out = tmp_path / "s.md", tmp_path / "b.md", tmp_path / "a.json"
    source.write_text(SOURCE)
    better.write_text(BETTER)
    assert cli.main(["analyze", str(source), "--output", str(out)]) == 0
    assert json.loads(out.read_text())["documents"][0]["findings"]
    source.write_text(SOURCE + " More.")
    assert cli.main(["verify", str(out)]) == 1
    capsys.readouterr()
    assert cli.main(["grade", str(better), "--sentences"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["words"] == 8
    assert cli.main(["profiles"]) == 0 and len(json.loads(capsys.readouterr().out)) == 5
    with pytest.raises(ValueError):
        cli.main(["analyze", str(source), "--output", str(source)])
    (tmp_path / "e.md").write_text(" ")
    with pytest.raises(SystemExit):
        cli.main(["analyze", str(tmp_path / "e.md")])
