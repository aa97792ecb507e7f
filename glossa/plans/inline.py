"""Queries over inline rows: the same literals in Spark and in DuckDB.

The generated tables have no markup, claims or annotated tokens; these rows do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import analysis
from glossa.operators import claims as C
from glossa.operators import dependencies as D
from glossa.operators import meaning as M
from glossa.operators import purposes as U
from glossa.operators import stemming
from glossa.operators.annotate import tokens as annotated
from glossa.operators.blocks import blocks
from glossa.plans import fixture
from glossa.plans import oracles as O
from glossa.sources import profiles as P

_USUAL = P.load_profile()

TOKENS = [  # doc_id, sentence_index, index, text, lemma, pos, dep, head
    (1, 0, 0, "The", "the", "DET", "det", 1), (1, 0, 1, "decision", "decision", "NOUN", "nsubjpass", 4), (1, 0, 2, "must", "must", "AUX", "aux", 4), (1, 0, 3, "be", "be", "AUX", "auxpass", 4),
    (1, 0, 4, "approved", "approve", "VERB", "ROOT", 4), (1, 0, 5, ".", ".", "PUNCT", "punct", 4),
    (1, 1, 6, "The", "the", "DET", "det", 8), (1, 1, 7, "platform", "platform", "NOUN", "compound", 8), (1, 1, 8, "team", "team", "NOUN", "nsubj", 9), (1, 1, 9, "reviews", "review", "VERB", "ROOT", 9),
    (1, 1, 10, "service", "service", "NOUN", "compound", 13), (1, 1, 11, "account", "account", "NOUN", "compound", 13), (1, 1, 12, "access", "access", "NOUN", "compound", 13), (1, 1, 13, "policy", "policy", "NOUN", "dobj", 9),
    (1, 1, 14, "and", "and", "CCONJ", "cc", 9), (1, 1, 15, "closes", "close", "VERB", "conj", 9), (1, 1, 16, "gaps", "gap", "NOUN", "dobj", 15),
    (2, 0, 0, "Gaps", "gap", "NOUN", "nsubjpass", 2), (2, 0, 1, "were", "be", "AUX", "auxpass", 2), (2, 0, 2, "closed", "close", "VERB", "ROOT", 2), (2, 0, 3, "by", "by", "ADP", "agent", 2), (2, 0, 4, "us", "we", "PRON", "pobj", 3),
    (2, 1, 5, "It", "it", "PRON", "nsubjpass", 7), (2, 1, 6, "is", "be", "AUX", "auxpass", 7), (2, 1, 7, "expected", "expect", "VERB", "ROOT", 7), (2, 1, 8, "to", "to", "PART", "aux", 9), (2, 1, 9, "work", "work", "VERB", "xcomp", 7),
]
TOKEN_SCHEMA = "doc_id int, sentence_index int, index int, text string, lemma string, pos string, dep string, head int"

QUANTITIES = [
    "at least 5 seconds", "at most 5 seconds", "two", "either", "both", "5 kg", "12 pounds", "more than 1,000", "under 3 days", "2024-01-31", "50%", ">= 7", "< 2 hours", "no more than ten weeks", "99.5 percent",
]
PHRASES = ["platform team", "the of audit findings", "c b a z", "single", "gaps the authorization"]
CLAIMS = [  # pair_id, side, actor, action, target, modality, polarity, status
    (1, "source", "unspecified", "resolve", "gap", "must", "positive", "asserted"), (1, "candidate", "team", "resolve", "gap", "must", "positive", "asserted"),
    (2, "source", "team", "review", "plan", "must", "positive", "asserted"), (2, "source", "team", "review", "plan", "must", "positive", "asserted"), (2, "candidate", "team", "review", "plan", "must", "positive", "asserted"),
    (3, "source", "team", "deploy", "it", "none", "positive", "asserted"), (3, "source", "team", "deploy", "cache", "none", "negative", "asserted"), (3, "candidate", "team", "deploy", "cache", "none", "negative", "asserted"),
    (4, "source", "team", "note", "risk", "none", "positive", "asserted"), (4, "candidate", "team", "note", "risk", "none", "positive", "asserted"),
]
CLAIM_SCHEMA = "pair_id int, side string, actor string, action string, target string, modality string, polarity string, status string"
PAIRS = [(1, "a", "b"), (2, "c", "d"), (3, "e", "f"), (4, "g", "g"), (5, "same", "same")]
JUDGED = [  # disposition, values, words, rules of high severity
    (1, "equivalent", 70.46, 84.28, 90, 80, ["A"], []), (2, "changed", 80.0, 90.0, 90, 80, [], []), (3, "equivalent", 80.0, 80.0, 200, 221, [], ["B"]), (4, "unresolved", 80.0, 79.0, 50, 63, ["A"], ["A", "C"]),
]
JUDGED_SCHEMA = "pair_id int, disposition string, source_value double, candidate_value double, source_words int, candidate_words int, source_high array<string>, candidate_high array<string>"
ATTEMPTS = [(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, False), (2, 2, False), (2, 3, True), (3, 0, True), (4, 0, False)]
STEMS = ["ratification", "ratify", "authorisation", "authorize", "decision", "decide", "connection", "connect", "provisioning", "logging", "deployment", "approval", "closure", "resolution", "resolve"]
MARKDOWN = [
    (1, "# Title\n\nProse that\nwraps.\n\n- one\n- two\n  more\n\n> quote\n\n```\ncode | x\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\nEnd\n===\n"), (2, "    indented\n\n<div>\nx\n</div>\n\n1) item\r\n\r\nlast"), (3, ""),
]
TEXT_PAIRS = [  # pair_id, source, candidate
    (1, "The platform team must resolve the authorization gaps.", "The authorization gaps must be resolved by the platform team."),
    (2, "Verify the two outstanding data loss hypotheses.", "Verify the three outstanding data loss hypotheses."),
    (3, "Close the audit findings before the design returns for sign-off.", "Close the audit findings after the design returns for sign-off."),
    (4, "The platform team must resolve the authorization gaps.", "The authorization gaps must be resolved."),
    (5, "The authorization gaps must be resolved.", "The platform team must resolve the authorization gaps."),
    (6, "The operator must quarantine the cache.", "The operator shall quarantine the cache."),
    (7, "The operator must quarantine the cache.", "The operator must not quarantine the cache."),
    (8, "Fix the outage.", "Remediate the outage."),
    (9, "The operator must quarantine the cache.", "The operator should quarantine the cache."),
]
ADVICE = [
    (1, 0, "The team must fix the outage and confirm the decision before the gate opens."), (1, 1, "The team should resolve that outage quickly."), (1, 2, "All is quiet."), (1, 3, "They shall remediate outage causes and verify claims."),
    (2, 0, "You should publish notes."), (2, 1, "You should document notes, approve plans, fix gaps until the validation is done."), (3, 0, "Nothing to do."),
]


def values(rows: list[tuple], names: str) -> str:
    """A DuckDB VALUES table."""

    def shown(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(shown, x)) + "]::VARCHAR[]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


def tokens(s: SparkSession) -> DataFrame:
    return s.createDataFrame(TOKENS, TOKEN_SCHEMA)


def claims(s: SparkSession) -> DataFrame:
    return s.createDataFrame(CLAIMS, CLAIM_SCHEMA)


_T = values(TOKENS, "doc_id, sentence_index, index, text, lemma, pos, dep, head")
_C = values(CLAIMS, "pair_id, side, actor, action, target, modality, polarity, status")
_FIELDS = ["action", "actor", "modality", "polarity", "status", "target"]
_PASSIVE = f"""SELECT v.doc_id, v.sentence_index, v.index, v.lemma FROM {_T.replace(' t(', ' v(')} WHERE v.pos = 'VERB' AND v.dep NOT IN ('amod', 'acomp')
AND EXISTS (SELECT 1 FROM {_T} WHERE t.doc_id = v.doc_id AND t.head = v.index AND t.head <> t.index AND t.dep IN ({O.quoted(D.PASSIVE)}))"""


def signatures(s: SparkSession) -> DataFrame:
    return claims(s).select("pair_id", "side", M.claim_signature({k: k for k in _FIELDS}).alias("signature"))


_SIGNATURES = f"SELECT pair_id, side, 'claim:' || {' || '.join(f'''{chr(39)}{';' if i else ''}{k}={chr(39)} || {k}''' for i, k in enumerate(_FIELDS))} AS signature FROM {_C}"
_DIFF = f"""SELECT * FROM (SELECT pair_id, signature, CAST(greatest(sum(CASE side WHEN 'source' THEN 1 ELSE -1 END), 0) AS BIGINT) AS missing,
CAST(greatest(-sum(CASE side WHEN 'source' THEN 1 ELSE -1 END), 0) AS BIGINT) AS added FROM ({_SIGNATURES}) GROUP BY ALL) WHERE missing + added > 0"""


def _difference(s: SparkSession) -> DataFrame:
    return M.multiset_difference(signatures(s))


def _reconciled(s: SparkSession) -> DataFrame:
    rows = claims(s)
    other = [c for c in rows.columns if c != "side"]
    source, candidate = rows.filter("side = 'source'").select(*other), rows.filter("side = 'candidate'").select(*other)
    return M.reconciled_actors(source.exceptAll(candidate), candidate.exceptAll(source))


_OTHER = "pair_id, actor, action, target, modality, polarity, status"
_REST = "pair_id, action, target, modality, polarity, status"
_RECONCILED = f"""WITH a AS (SELECT {_OTHER} FROM {_C} WHERE side = 'source'), b AS (SELECT {_OTHER} FROM {_C} WHERE side = 'candidate'),
l AS (SELECT *, row_number() OVER (PARTITION BY {_REST} ORDER BY actor) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) WHERE actor = 'unspecified'),
r AS (SELECT *, row_number() OVER (PARTITION BY {_REST} ORDER BY actor) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) WHERE actor <> 'unspecified')
SELECT {_REST}, r.actor FROM l JOIN r USING ({_REST}, n)"""
_VAGUE = "('it', 'this', 'that', 'them', 'these', 'those', 'unspecified')"
_CONFLICTS = f"""WITH c AS (SELECT * FROM {_C} WHERE side = 'source') SELECT a.pair_id, a.action, a.target AS affirmed, b.target AS denied FROM c a JOIN c b USING (pair_id, action)
WHERE a.polarity = 'positive' AND b.polarity = 'negative' AND (a.target = b.target OR a.target IN {_VAGUE} OR b.target IN {_VAGUE})"""


def _dispositions(s: SparkSession) -> DataFrame:
    doubts = M.polarity_conflicts(claims(s).filter("side = 'source'"))
    return M.dispositions(s.createDataFrame(PAIRS, "pair_id int, source string, candidate string"), _difference(s), doubts)


_SIGN = " ".join(
    f"WHEN {f'''starts_with(q, '{p} ')''' if p[0].isalpha() else f'''starts_with(q, '{p}') {f'''AND NOT starts_with(q, '{p}=')''' if p in '<>' else ''}'''} THEN '{k}'" for k, ps in M.OPERATORS.items() for p in ps
)
_WORD = "regexp_extract(q, '\\b(" + "|".join(M.NUMBERS) + ")\\b', 1)"
_QUANTITY = f"""SELECT phrase, CASE WHEN regexp_matches(q, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'date=' || q WHEN q = 'either' THEN 'quantifier=either'
ELSE 'operator=' || CASE {_SIGN} ELSE 'eq' END || CASE WHEN unit <> '' THEN ';unit=' || unit ELSE '' END || ';value=' || CASE WHEN digits <> '' THEN digits ELSE named END END AS normalized
FROM (SELECT *, CASE WHEN last IN ('%', 'percent') THEN 'percent' WHEN one IN ({O.quoted(M.DURATIONS)}) THEN one WHEN last IN ('kg', 'kgs', 'kilogram', 'kilograms') THEN 'kg'
  WHEN last IN ('lb', 'lbs', 'pound', 'pounds') THEN 'lb' ELSE '' END AS unit FROM (SELECT *, regexp_replace(last, 's$', '') AS one FROM (SELECT phrase, q, regexp_extract(q, '([a-z%]+)$', 1) AS last,
  replace(regexp_extract(q, '\\d[\\d,]*(?:\\.\\d+)?'), ',', '') AS digits, CASE {_WORD} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in M.NUMBERS.items())} ELSE '' END AS named
  FROM (SELECT phrase, lower(trim(phrase)) AS q FROM {values([(q,) for q in QUANTITIES], 'phrase')}))))"""

# What the queries without SQL must give, stated by hand.
BLOCKS = [
    (1, 0, "heading", 0, 7, "# Title"), (1, 1, "prose", 9, 26, "Prose that\nwraps."), (1, 2, "list_item", 28, 33, "- one"), (1, 3, "list_item", 34, 46, "- two\n  more"), (1, 4, "blockquote", 48, 55, "> quote"),
    (1, 5, "code", 57, 73, "```\ncode | x\n```"), (1, 6, "table", 75, 104, "| a | b |\n|---|---|\n| 1 | 2 |"), (1, 7, "rule", 106, 109, "---"), (1, 8, "heading", 110, 117, "End\n==="),
    (2, 0, "code", 0, 12, "    indented"), (2, 1, "html", 14, 28, "<div>\nx\n</div>"), (2, 2, "list_item", 30, 37, "1) item"), (2, 3, "prose", 41, 45, "last"),
]
STEMMED = list(zip(STEMS, ["ratif", "ratif", "authoriz", "authoriz", "decis", "decis", "connec", "connec", "provis", "logging", "deploy", "approv", "clos", "resolv", "resolv"], strict=True))


def _claim(action: str, actor: str, target: str, modality: str = "must", polarity: str = "positive") -> str:
    return f"claim:action={action};actor={actor};modality={modality};polarity={polarity};status=asserted;target={target}"


COMPARED = [
    (1, "equivalent", "", "", 0), (2, "changed", _claim("verif", "unspecified", "2 data loss outstanding hypothesis"), _claim("verif", "unspecified", "3 data loss outstanding hypothesis"), 0),
    (3, "changed", "order:earlier=audit finding;later=design", "order:earlier=design;later=audit finding", 0),
    (4, "changed", _claim("resolv", "platform team", "authorization gap"), _claim("resolv", "unspecified", "authorization gap"), 0), (5, "equivalent", "", "", 1), (6, "equivalent", "", "", 0),
    (7, "changed", _claim("quarantin", "operator", "cache"), _claim("quarantin", "operator", "cache", polarity="negative"), 0), (8, "equivalent", "", "", 0),
    (9, "changed", _claim("quarantin", "operator", "cache"), _claim("quarantin", "operator", "cache", "should"), 0),
]
_ONE_CLAUSE = [(1, 0, "platform team", "resolv", "authorization gap"), (2, 0, "unspecified", "verif", "2 data loss outstanding hypothesis"), (4, 0, "platform team", "resolv", "authorization gap"), (5, 0, "unspecified", "resolv", "authorization gap"), (6, 0, "operator", "quarantin", "cache"), (7, 0, "operator", "quarantin", "cache"), (8, 0, "unspecified", "resolv", "outage"), (9, 0, "operator", "quarantin", "cache")]
CLAIMED = [(*c, "must", "positive", "asserted") for c in _ONE_CLAUSE]


def advice(s: SparkSession) -> DataFrame:
    return s.createDataFrame(ADVICE, "doc_id int, sentence_index int, sentence string")


_A = values(ADVICE, "doc_id, sentence_index, sentence")
_LEMMAS = f"list_transform({O.lowered_words()}, lambda w: CASE WHEN w IN ('am', 'is', 'are', 'was', 'were', 'been', 'being') THEN 'be' WHEN w IN ('has', 'had', 'having') THEN 'have' ELSE w END)"
_LABELS = ", ".join("CASE WHEN " + " OR ".join(f"contains(line, ' {m} ')" for m in ms) + f" THEN '{k}' END" for k, ms in sorted(_USUAL.phrases('purpose_markers').items()))


def mixed_sql(source: str) -> str:
    return f"""SELECT doc_id, sentence_index, CAST(len(l) AS INTEGER) AS n, array_to_string(l, ', ') AS labels, CAST(least(14.0, (len(l) - 2) * 4.0) AS DOUBLE) AS penalty
FROM (SELECT *, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS l FROM (SELECT *, ' ' || array_to_string({_LEMMAS}, ' ') || ' ' AS line FROM {source})) WHERE len(l) > 2"""


_GROUPS = ", ".join(f"CASE WHEN list_has_any(w, [{O.quoted(vs)}]) THEN '{k}' END" for k, vs in sorted(_USUAL.phrases('recommendation_action_groups').items()))
_KNOWN = O.quoted([v for vs in _USUAL.phrases('recommendation_action_groups').values() for v in vs] + P.STOP_LEMMAS + U.DIRECTIVES)


def twice_sql(source: str) -> str:
    return f"""WITH r AS (SELECT doc_id, sentence_index, w FROM (SELECT *, {_LEMMAS} AS w FROM {source}) WHERE list_has_any(w, [{O.quoted(U.DIRECTIVES)}])),
g AS (SELECT doc_id, sentence_index, w, unnest(list_filter([{_GROUPS}], lambda x: x IS NOT NULL)) AS action_group FROM r),
k AS (SELECT doc_id, sentence_index, action_group, unnest(list_distinct(list_filter(w, lambda x: length(x) >= 5 AND x NOT IN ({_KNOWN})))) AS term FROM g),
p AS (SELECT b.doc_id, b.sentence_index, a.sentence_index AS earlier, action_group FROM k a JOIN k b USING (doc_id, action_group, term) WHERE a.sentence_index < b.sentence_index)
SELECT doc_id, sentence_index, min(earlier) AS earlier, arg_min(action_group, (earlier, action_group)) AS action_group FROM p GROUP BY ALL"""


def _fixture_findings(s: SparkSession) -> DataFrame:
    docs = s.createDataFrame(list(fixture.TEXTS.items()), "doc_id int, text string")
    found = analysis.findings(docs, _USUAL).join(docs, "doc_id")
    return found.select("doc_id", "rule_id", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("excerpt"))


QUERIES = {
    "r19_mixed_purposes": (lambda s, d: U.mixed_purposes(advice(s)), mixed_sql(_A)),
    "r22_duplicated_recommendations": (lambda s, d: U.duplicated_recommendations(advice(s)), twice_sql(_A)),
    "r10_passive_verbs": (lambda s, d: D.passive_verbs(tokens(s)), _PASSIVE),
    "r9_agentless_decisions": (
        lambda s, d: D.agentless_decisions(tokens(s)),
        f"""SELECT * FROM ({_PASSIVE}) p WHERE NOT EXISTS (SELECT 1 FROM {_T} WHERE t.doc_id = p.doc_id AND t.head = p.index AND t.dep = 'agent')
AND EXISTS (SELECT 1 FROM {_T} WHERE t.doc_id = p.doc_id AND t.head = p.index AND t.head <> t.index AND ((t.dep = 'aux' AND t.lemma IN ({O.quoted(D.OBLIGATION)}))
OR (t.dep IN ({O.quoted(D.SUBJECTS)}) AND t.lemma IN ({O.quoted(D.IMPERSONAL + D.ABSTRACT)}))))""",
    ),
    "r2_r3_sentence_loads": (
        lambda s, d: D.sentence_loads(tokens(s)),
        f"""SELECT doc_id, sentence_index, count(*) FILTER (pos = 'VERB' AND dep NOT IN ({O.quoted(D.NOT_HEADS)})) AS actions,
1 + count(*) FILTER (pos = 'VERB' AND (dep IN ({O.quoted(D.CLAUSAL)}) OR (dep = 'conj' AND EXISTS (SELECT 1 FROM {_T.replace(' t(', ' h(')} WHERE h.doc_id = t.doc_id AND h.index = t.head AND h.pos = 'VERB')))) AS clauses
FROM {_T} GROUP BY doc_id, sentence_index""",
    ),
    "r6_noun_stacks": (
        lambda s, d: D.noun_stacks(tokens(s)),
        f"""WITH t AS (SELECT * FROM {_T}), m AS (SELECT h.doc_id, h.sentence_index, h.index AS root, h.text AS head_text, h.index - t.index AS d FROM t JOIN t h ON t.doc_id = h.doc_id AND t.sentence_index = h.sentence_index
  AND h.index > t.index AND h.index - t.index <= 12 WHERE t.pos IN ('NOUN', 'PROPN', 'ADJ') AND t.dep IN ('compound', 'amod') AND h.pos IN ('NOUN', 'PROPN') AND h.dep <> 'compound'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, root ORDER BY d) AS n FROM m)
SELECT * FROM (SELECT doc_id, sentence_index, root, head_text, CAST(count(*) FILTER (n = d) + 1 AS INTEGER) AS depth FROM r GROUP BY ALL) WHERE depth >= 3""",
    ),
    "n_subtree_closure": (
        lambda s, d: D.subtree(tokens(s)),
        f"""WITH RECURSIVE t AS (SELECT * FROM {_T}), below(doc_id, root, index) AS (SELECT doc_id, index, index FROM t
UNION ALL SELECT b.doc_id, b.root, t.index FROM below b JOIN t ON t.doc_id = b.doc_id AND t.head = b.index AND t.index <> t.head) SELECT doc_id, root, index FROM below""",
    ),
    "m6_quantities": (lambda s, d: s.createDataFrame([(q,) for q in QUANTITIES], "phrase string").select("phrase", M.quantity(F.col("phrase")).alias("normalized")), _QUANTITY),
    "m20_signatures": (lambda s, d: signatures(s), _SIGNATURES),
    "c1_folded_phrases": (
        lambda s, d: s.createDataFrame([(p,) for p in PHRASES], "phrase string").select("phrase", M.folded(F.col("phrase")).alias("folded")),
        f"SELECT phrase, array_to_string(list_concat(list_sort(w[:-2]), w[-1:]), ' ') AS folded FROM (SELECT phrase, string_split(phrase, ' ') AS w FROM {values([(p,) for p in PHRASES], 'phrase')})",
    ),
    "c2_multiset_difference": (lambda s, d: _difference(s), _DIFF),
    "c3_named_actors": (lambda s, d: _reconciled(s), _RECONCILED),
    "c5_polarity_conflicts": (lambda s, d: M.polarity_conflicts(claims(s).filter("side = 'source'")), _CONFLICTS),
    "c8_dispositions": (
        lambda s, d: _dispositions(s),
        f"""SELECT pair_id, CASE WHEN sha256(source) = sha256(candidate) THEN 'equivalent' WHEN pair_id IN (SELECT pair_id FROM ({_CONFLICTS})) THEN 'unresolved'
WHEN pair_id IN (SELECT pair_id FROM ({_DIFF})) THEN 'changed' ELSE 'equivalent' END AS disposition FROM {values(PAIRS, 'pair_id, source, candidate')}""",
    ),
    "c15_judged_candidates": (
        lambda s, d: M.judged(s.createDataFrame(JUDGED, JUDGED_SCHEMA)),
        f"""SELECT pair_id, len(r) = 0 AS accepted, coalesce(array_to_string(r, ','), '') AS reasons, allowed AS allowed_words FROM (SELECT *, list_filter([
CASE WHEN disposition <> 'equivalent' THEN 'meaning_' || disposition END, CASE WHEN candidate_value <= source_value THEN 'score_not_improved' END,
CASE WHEN len(list_filter(candidate_high, lambda x: NOT list_contains(source_high, x))) > 0 THEN 'new_high_severity' END, CASE WHEN candidate_words > allowed THEN 'too_long' END], lambda x: x IS NOT NULL) AS r
FROM (SELECT *, source_words + CAST(greatest(12, ceil(source_words * 10 / 100)) AS BIGINT) AS allowed FROM {values(JUDGED, 'pair_id, disposition, source_value, candidate_value, source_words, candidate_words, source_high, candidate_high')}))""",
    ),
    "c17_first_accepted": (
        lambda s, d: M.first_accepted(s.createDataFrame(ATTEMPTS, "source_id int, index int, accepted boolean")),
        f"""SELECT source_id, coalesce(min(index) FILTER (accepted) + 1, count(*)) AS attempts, coalesce(min(index) FILTER (accepted), -1) AS accepted_index
FROM {values(ATTEMPTS, 'source_id, index, accepted')} WHERE index < 3 GROUP BY source_id""",
    ),
    "m13_claims": (  # the third text has two clauses and is part of c0 alone
        lambda s, d: C.claims(annotated(s.createDataFrame([(i, 0, t) for i, t, _ in TEXT_PAIRS if i != 3], "doc_id int, sentence_index int, sentence string"))).drop("index"),
        f"SELECT * FROM {values(CLAIMED, 'doc_id, sentence_index, actor, action, target, modality, polarity, status')}",
    ),
    "c0_compared_texts": (
        lambda s, d: C.compare_texts(s.createDataFrame(TEXT_PAIRS, "pair_id int, source string, candidate string")),
        f"SELECT pair_id, disposition, missing, added, CAST(specified AS BIGINT) AS specified FROM {values(COMPARED, 'pair_id, disposition, missing, added, specified')}",
    ),
    "m18_action_stems": (lambda s, d: s.createDataFrame([(w,) for w in STEMS], "word string").select("word", stemming.stem(F.col("word")).alias("stem")), f"SELECT * FROM {values(STEMMED, 'word, stem')}"),
    "st1_blocks": (lambda s, d: blocks(s.createDataFrame(MARKDOWN, "doc_id int, text string"), ["doc_id"]), f"""SELECT * FROM {values(BLOCKS, 'doc_id, block_index, kind, start, "end", text')}"""),
    "r29_fixture_findings": (
        lambda s, d: _fixture_findings(s),
        f"SELECT doc_id, 'LING-' || rule || '-001' AS rule_id, excerpt FROM {values(fixture.EXPECTED, 'doc_id, rule, excerpt')}",
    ),
    "st1_conversation_blocks": (lambda s, d: blocks(s.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"]), None),
}
