"""Registered queries of the text-governance engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import readability as R
from glossa.plans import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("lang") == "en")


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


register("g_readability_documents", lambda s, d: R.document_grades(english(s, d)), O.document_grades())
register("g_readability_raw", lambda s, d: R.document_grades(english(s, d), normalize=False), O.document_grades(False))
register("g4_readability_of_prose", lambda s, d: R.document_grades(R.readable(english(s, d))), O.document_grades(source=O.readable()))
register("g_readability_sentences", lambda s, d: R.sentence_grades(english(s, d)), O.sentence_grades())
register(
    "r25_grade_findings",
    lambda s, d: R.grade_findings(english(s, d)),
    f"""SELECT doc_id, sentence_index, 'LING-GRADE-001' AS rule_id, 'sentence_load' AS dimension, flesch_kincaid AS observed,
CASE WHEN flesch_kincaid / 8.0 >= 2 THEN 'high' WHEN flesch_kincaid / 8.0 >= 1.35 THEN 'medium' ELSE 'low' END AS severity,
least(15.0, {O.round2('(flesch_kincaid - 8.0) * 1.5')}) AS penalty FROM ({O.sentence_grades()}) WHERE words >= 5 AND flesch_kincaid > 8.0""",
)
register(
    "g_readability_by_source",
    lambda s, d: R.grades_by_source(english(s, d)),
    f"""SELECT lang, source, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences,
min(flesch_kincaid) AS least_grade, max(flesch_kincaid) AS most_grade
FROM ({O.document_grades()}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""",
)

# --- findings and scores over documents -------------------------------------------------------------

from glossa.functions import text as X  # noqa: E402
from glossa.operators import analysis  # noqa: E402
from glossa.operators import findings as D  # noqa: E402
from glossa.operators import meaning as M  # noqa: E402
from glossa.operators import protection  # noqa: E402
from glossa.operators.blocks import block_counts, blocks  # noqa: E402
from glossa.operators import scoring as S  # noqa: E402
from glossa.sources import profiles as P  # noqa: E402

USUAL = P.load_profile()
#: Phrases that the generated documents have, to exercise the matcher on data.
DATA_PHRASES = {"placing": ["in the", "of the"], "being": ["it be", "that be"]}


def _sentences(s: SparkSession, d: str) -> DataFrame:
    return X.sentences(english(s, d), ["doc_id"])


_LOCAL = {"r1_long_sentences": "SENTENCE", "r4_punctuation_depth": "PUNCTUATION", "r5_nominalizations": "NOMINALIZATION", "r18_inline_lists": "LIST", "r7_compound_depth": "COMPOUND-DEPTH", "r15_compounds": "COMPOUND"}
for (_name, _rule), _oracle in zip(_LOCAL.items(), [*O.sentence_rules(USUAL), *O.compound_rules(USUAL)], strict=True):
    register(_name, lambda s, d, r=_rule: D.local_findings(english(s, d), USUAL, [r]), _oracle)
register("st16_hyphen_terms", lambda s, d: D.hyphen_terms(_sentences(s, d)), O.hyphen_terms())
register("r16_undefined_acronyms", lambda s, d: D.acronym_rule(english(s, d), _sentences(s, d), USUAL), O.acronym_rule(USUAL))
register("r17_long_paragraphs", lambda s, d: D.paragraph_rule(english(s, d), USUAL), O.paragraph_rule(USUAL))
register("r20_repeated_words", lambda s, d: D.repeated_words_rule(english(s, d), USUAL), O.repeated_words_rule(USUAL))
register("r21_filler_phrases", lambda s, d: D.local_findings(english(s, d), USUAL, ["FILLER"], DATA_PHRASES), O.filler_rule(DATA_PHRASES))
register("r26_phrase_matches", lambda s, d: D.phrase_counts(_sentences(s, d), DATA_PHRASES), O.phrase_counts(DATA_PHRASES))
register("r24_qualifiers", lambda s, d: D.local_findings(english(s, d), USUAL, ["QUALIFIER"]), O.qualifier_rule(USUAL))
register("r29_findings", lambda s, d: D.findings(english(s, d), USUAL), O.findings(USUAL))
for _profile in P.WEIGHTS:
    _p = P.load_profile(_profile)

    def _scored(s: SparkSession, d: str, p: P.Profile = _p) -> DataFrame:
        return S.scores(S.components(english(s, d), D.findings(english(s, d), p), p), p)

    register(f"a3_score_{_profile.replace('-', '_')}", _scored, O.scores(_p))
register("a1_score_components", lambda s, d: S.components(english(s, d), D.findings(english(s, d), USUAL), USUAL), O.components(USUAL))
register(
    "c16_ranked_findings",
    lambda s, d: S.ranked(D.findings(english(s, d), USUAL)),
    f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, sentence_index NULLS FIRST, rule_id, observed, penalty) AS rank
FROM ({O.findings(USUAL)})""",
)
register(
    "a2_score_floor",
    lambda s, d: s.range(2401).select((F.col("id") / 2).alias("deducted"), S.raw_score(F.col("id") / 2).alias("raw_score")),
    f"SELECT i / 2 AS deducted, {O.round2('100 * pow(2, -(i / 2) / 50)')} AS raw_score FROM range(2401) t(i)",
)


def _blocks(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/conversations.parquet")
    kind = F.when(F.col("role") == "assistant", "list_item").otherwise("prose")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_index"), kind.alias("kind"), "text")


register(
    "r23_duplicated_framing",
    lambda s, d: D.duplicated_framing(_blocks(s, d), P.Profile("wide", "1.0.0", USUAL.weights, USUAL.bands, USUAL.thresholds | {"max_duplicate_framing_words": 300, "min_duplicate_framing_shared_terms": 2, "min_duplicate_framing_similarity": 0.1})),
    O.duplicated_framing(
        "SELECT conv_id AS doc_id, turn AS block_index, CASE WHEN role = 'assistant' THEN 'list_item' ELSE 'prose' END AS kind, text FROM conversations",
        P.Profile("wide", "1.0.0", USUAL.weights, USUAL.bands, USUAL.thresholds | {"max_duplicate_framing_words": 300, "min_duplicate_framing_shared_terms": 2, "min_duplicate_framing_similarity": 0.1}),
    ),
)


# --- places, digests, protected elements ------------------------------------------------------------


def _places(s: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", " the ")
    line, column = X.line_column(F.col("text"), at)
    return english(s, d).filter(at > 0).select("doc_id", at.cast("int").alias("start"), line.cast("int").alias("line"), column.cast("int").alias("column"))


register(
    "st13_line_column",
    _places,
    f"""SELECT doc_id, CAST(pos AS INTEGER) AS start, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INTEGER) AS line,
CAST(length(string_split(p, chr(10))[-1]) + 1 AS INTEGER) AS "column" FROM (SELECT doc_id, pos, substring(text, 1, pos) AS p FROM (SELECT *, instr(text, ' the ') AS pos FROM {O.EN}) WHERE pos > 0)""",
)
register(
    "io1_source_digest",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.length("text").alias("length")),
    "SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS length FROM documents",
)
register(
    "m1_protected_items",
    lambda s, d: M.regex_items(s.read.parquet(f"{d}/pages.parquet").withColumn("html", F.concat_ws(" ", "url", "html")), "html", "page_id"),
    "SELECT page_id, kind, CASE WHEN kind = 'identifier' THEN upper(item) ELSE item END AS item, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(url || ' ' || html, '{p.replace(chr(39), chr(39) * 2)}')) AS item FROM pages" for k, p in M.PATTERNS.items())
    + ") GROUP BY ALL",
)

# --- inline rows and streams ------------------------------------------------------------------------

from glossa.plans import inline  # noqa: E402
from glossa.streaming import feed  # noqa: E402

from glossa.operators.annotate import tokens as annotated  # noqa: E402

register("st10_annotated_tokens", lambda s, d: annotated(_sentences(s, d)))
register("m13_document_claims", lambda s, d: inline.C.claims_of(_sentences(s, d)))
#: The rules over tokens and purposes on whole documents; the inline queries of like names hold them against SQL.
register("r2_r3_document_sentence_loads", lambda s, d: inline.D.sentence_loads(annotated(_sentences(s, d))))
register("r6_document_noun_stacks", lambda s, d: inline.D.noun_stacks(annotated(_sentences(s, d))))
register("r9_document_agentless_decisions", lambda s, d: inline.D.agentless_decisions(annotated(_sentences(s, d))))
register("r10_document_passive_verbs", lambda s, d: inline.D.passive_verbs(annotated(_sentences(s, d))))
register("r19_document_mixed_purposes", lambda s, d: inline.U.mixed_purposes(_sentences(s, d)), inline.mixed_sql(f"({O.sentences()})"))
register("r22_document_duplicated_recommendations", lambda s, d: inline.U.duplicated_recommendations(_sentences(s, d)), inline.twice_sql(f"({O.sentences()})"))
#: All rules over annotated documents; the fixture query of the same operator has labelled rows.
register("r29_all_findings", lambda s, d: analysis.findings(english(s, d), USUAL))
register("m4_protected_manifest", lambda s, d: protection.manifest(english(s, d)))
register("r28_sentence_records", lambda s, d: analysis.sentence_records(english(s, d)))
register("a3_all_score_architecture_review", lambda s, d: S.scores(S.components(english(s, d), analysis.findings(english(s, d), USUAL), USUAL), USUAL))
register("st8_block_counts", lambda s, d: block_counts(blocks(english(s, d), ["doc_id"]), "doc_id"))
for _name, (_query, _oracle) in inline.QUERIES.items():
    register(_name, _query, _oracle)
register(
    "s1_hourly_windows",
    lambda s, d: feed.window_averages(s.read.parquet(f"{d}/events.parquet")),
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
)
register(
    "s2_user_sessions",
    lambda s, d: feed.sessions(s.read.parquet(f"{d}/events.parquet")),
    """SELECT min(ts) AS session_start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""",
)
