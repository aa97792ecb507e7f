"""The text-governance operators on small rows with known answers."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glossa.functions import text as X
from glossa.operators import claims
from glossa.operators import findings as D
from glossa.operators import meaning as M
from glossa.operators import readability as R
from glossa.operators import scoring as S
from glossa.operators.annotate import annotate, tokens
from glossa.operators.blocks import block_counts, blocks, code_spans, segment
from glossa.operators.stemming import stem
from glossa.plans import inline
from glossa.sources import files
from glossa.sources import profiles as P
from glossa.streaming import feed

USUAL = P.load_profile()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_readability_anchor(spark):
    row = R.document_grades(docs(spark, "The cat sat on the mat.")).first().asDict()
    want = {"words": 6, "sentences": 1, "syllables": 6, "characters": 17, "polysyllables": 0, "flesch_kincaid": -1.45, "flesch_ease": 116.15, "coleman_liau": -4.07, "smog": 3.13, "fog": 2.4, "ari": -5.09}
    assert {k: row[k] for k in want} == want


def test_readability_two_sentences(spark):
    row = R.document_grades(docs(spark, "Communication is important. We understand everything.")).first()
    assert (row.words, row.sentences, row.syllables, row.characters, row.flesch_kincaid) == (6, 2, 17, 46, 19.01)


@pytest.mark.parametrize("word, n", [("make", 1), ("table", 2), ("jumped", 1), ("wanted", 2), ("yellow", 2), ("rhythm", 1), ("qwrtz", 1), ("1234", 1), ("business", 3), ("well-known", 2), ("team's", 1)])
def test_syllables(spark, word, n):
    assert spark.range(1).select(X.syllables(F.lit(word))).first()[0] == n


def test_sentences(spark):
    got = X.sentences(docs(spark, "See Dr. Who, e.g. now.  Then go!\nYes? no", "", "   "), ["doc_id"]).collect()
    assert [r.sentence for r in got] == ["See Dr. Who, e.g. now.", "Then go!", "Yes?", "no"]


def test_readability_leaves_out_what_is_no_prose(spark):
    text = "Use `x = 1` and [the guide](https://a.b/c) as in https://x.y or (Doe, 2020) or [12] (p. 3)."
    assert R.readable(docs(spark, text)).first().text.split() == "Use and the guide as in or or .".split()


def test_figures_count_one_syllable(spark):
    row = R.document_grades(docs(spark, "Pay 1,250,000 now.")).first()
    assert (row.figures, row.syllables, row.characters) == (1, 3, 9)


def test_scores(spark):
    one = docs(spark, "x")
    rows = lambda *p: spark.createDataFrame([(0, d, x) for d, x in p], "doc_id long, dimension string, penalty double")
    value = lambda *p: S.scores(S.components(one, rows(*p), USUAL), USUAL).first()
    assert tuple(value())[1:] == (100.0, "clear")
    assert value(("sentence_load", 714.39)).value == 75.0
    assert value(*[(d, 40.0) for d in P.DIMENSIONS]).band == "revision_required"
    raw = {r.x: r.raw for r in spark.createDataFrame([(50.0,), (714.39,), (714.38,)], "x double").select("x", S.raw_score(F.col("x")).alias("raw")).collect()}
    assert raw == {50.0: 50.0, 714.39: 0.0, 714.38: 0.01}


def test_profiles():
    assert all(sum(P.load_profile(p).weights.values()) == 100 for p in P.WEIGHTS)
    assert len({P.load_profile(p).digest for p in P.WEIGHTS}) == 5
    with pytest.raises(ValueError):
        P.load_profile("none")


def test_rules_fire(spark):
    text = "A state-of-the-art-thing, a risk-driven plan and a well-known one, (a) b; c — d. We use XYZ, QRS and ABC very really now. It should be noted that the migrations repeat migrations and migrations. " + "word " * 100 + "."
    got = {r.rule_id for r in D.findings(docs(spark, text), USUAL).collect()}
    assert {f"LING-{x}-001" for x in ("SENTENCE", "PUNCTUATION", "COMPOUND-DEPTH", "COMPOUND", "ABBREVIATION", "STRUCTURE", "REDUNDANCY", "QUALIFIER")} <= got
    assert D.findings(docs(spark, "All is well."), USUAL).count() == 0


def test_defined_acronyms_are_known(spark):
    d = docs(spark, "The Xenon Yield Zone (XYZ) is here. XYZ and XYZ and XYZ again.")
    assert D.acronym_rule(d, X.sentences(d, ["doc_id"]), USUAL).count() == 0


def test_severity(spark):
    got = spark.createDataFrame([(50, 25), (34, 25), (26, 25), (1, 0), (2, 0)], "o int, t int").select(X.severity(F.col("o"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["high", "medium", "low", "low", "high"]


def test_framing_needs_a_list_item_between(spark):
    text = "several important migration windows remain closed"
    rows = [(1, 0, "prose", text), (1, 1, "list_item", "x"), (1, 2, "prose", text), (2, 0, "prose", text), (2, 1, "prose", text)]
    got = D.duplicated_framing(spark.createDataFrame(rows, "doc_id int, block_index int, kind string, text string"), USUAL).collect()
    assert [(r.doc_id, r.block_index, r.earlier) for r in got] == [(1, 2, 0)]


def test_blocks(spark):
    text = inline.MARKDOWN[0][1]
    assert [b.kind for b in segment(text)] == ["heading", "prose", "list_item", "list_item", "blockquote", "code", "table", "rule", "heading"]
    covered = "".join(text[b.start : b.end] for b in segment(text))
    assert "".join(covered.split()) == "".join(text.split())
    counts = {(r.doc_id, r.kind): r.n for r in block_counts(blocks(spark.createDataFrame(inline.MARKDOWN, "doc_id int, text string"), ["doc_id"]), "doc_id").collect()}
    assert counts[1, "list_item"] == 2 and counts[2, "html"] == 1 and not any(d == 3 for d, _ in counts)


def test_code_spans():
    assert [("a `b` ``c ` d`` e"[s:e]) for s, e in code_spans("a `b` ``c ` d`` e")] == ["`b`", "``c ` d``"]
    assert code_spans(r"\`no` open") == []


@pytest.mark.parametrize("a, b", [("ratification", "ratify"), ("authorisation", "authorize"), ("decision", "decide"), ("connection", "connect"), ("shardification", "shardify"), ("bluegreenization", "bluegreenize")])
def test_action_stems_agree(spark, a, b):
    assert spark.range(1).select(stem(F.lit(a)) == stem(F.lit(b))).first()[0]


def test_meaning(spark):
    got = [r[0] for r in spark.createDataFrame([("at least 5 seconds",), ("two",), ("either",), ("5 kg",)], "q string").select(M.quantity(F.col("q"))).collect()]
    assert got == ["operator=gte;unit=second;value=5", "operator=eq;value=2", "quantifier=either", "operator=eq;unit=kg;value=5"]
    assert {(r.pair_id, r.actor) for r in inline._reconciled(spark).collect()} == {(1, "team")}
    assert {r.pair_id: r.disposition for r in inline._dispositions(spark).collect()} == {1: "changed", 2: "changed", 3: "unresolved", 4: "equivalent", 5: "equivalent"}


def test_annotation():
    got = {t["text"]: (t["pos"], t["dep"], t["head"]) for t in annotate("The authorization gaps must be resolved by the platform team.")}
    assert got["gaps"] == ("NOUN", "nsubjpass", 5) and got["by"][1] == "agent" and got["team"][1] == "pobj" and got["authorization"] == ("NOUN", "compound", 2)
    assert annotate("") == [] and annotate("Hello")[0]["dep"] == "ROOT"
    assert {t["text"]: t["pos"] for t in annotate("The service is complete.")}["complete"] == "ADJ"


def test_compared_texts(spark):
    got = {r.pair_id: (r.disposition, r.specified) for r in claims.compare_texts(spark.createDataFrame(inline.TEXT_PAIRS, "pair_id int, source string, candidate string")).collect()}
    assert got == {1: ("equivalent", 0), 2: ("changed", 0), 3: ("changed", 0), 4: ("changed", 0), 5: ("equivalent", 1), 6: ("equivalent", 0), 7: ("changed", 0), 8: ("equivalent", 0), 9: ("changed", 0)}


def test_claims_of_one_text(spark):
    sent = spark.createDataFrame([(1, 0, "The operator shall quarantine the cache and review logs."), (2, 0, "Do not deploy the cache.")], "doc_id int, sentence_index int, sentence string")
    got = {(r.doc_id, r.actor, r.action, r.target, r.modality, r.polarity) for r in claims.claims(tokens(sent)).collect()}
    assert got == {
        (1, "operator", "quarantin", "cache", "must", "positive"), (1, "operator", "review", "log", "must", "positive"), (2, "unspecified", "deploy", "cache", "must", "negative"),
    }


def test_judgement(spark):
    got = {r.pair_id: r.reasons for r in M.judged(spark.createDataFrame(inline.JUDGED, inline.JUDGED_SCHEMA)).collect()}
    assert got == {1: "", 2: "meaning_changed", 3: "score_not_improved,new_high_severity,too_long", 4: "meaning_unresolved,score_not_improved,new_high_severity,too_long"}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=7 * i), i % 3, "abc"[i % 3], float(i)) for i in range(200)]
    table = spark.createDataFrame(rows, "ts timestamp, user_id int, event_type string, value double")
    table.write.parquet(f"{tmp_path}/in")
    stream = feed.window_averages(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("windows").collect()) == sorted(feed.window_averages(table).collect())


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "One.\nTwo.\n"), ("b.md", "É")):
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    got = {r.path[-4:]: r for r in files.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got["a.md"].text == "One.\nTwo.\n" and got["b.md"].sha256 == hashlib.sha256("É".encode()).hexdigest()
    files.write_json({"b": "é", "a": 1}, str(tmp_path / "o.json"))
    assert (tmp_path / "o.json").read_text() == '{\n  "a": 1,\n  "b": "\\u00e9"\n}\n'
    files.write_text("x\n\n", str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text() == "x\n"
    with pytest.raises(ValueError):
        files.guard_output(str(tmp_path / "in" / "a.md"), [str(tmp_path / "in" / ".." / "in" / "a.md")], [])
    with pytest.raises(ValueError):
        files.guard_output(str(tmp_path / "in" / "new"), [], [str(tmp_path / "in")])
    files.guard_output(str(tmp_path / "new"), [str(tmp_path / "in" / "a.md")], [str(tmp_path / "in")])


def test_syllable_tables(spark, tmp_path):
    (tmp_path / "d").write_text(";;; note\nEVERY EH1 V ER0 IY0 # x\nEVERY(2) EH1 V R IY0\naalborg AO1 L B AO0 R G\n")
    assert {tuple(r) for r in files.derive_syllables(spark, str(tmp_path / "d")).collect()} == {("every", 3), ("aalborg", 2)}


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 40


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
