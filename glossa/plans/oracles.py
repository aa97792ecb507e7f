"""DuckDB forms of the column expressions, for the oracle queries."""

from __future__ import annotations

from glossa.functions.text import ABBREVIATIONS

EN = "(SELECT * FROM documents WHERE lang = 'en')"
_ABBR = "(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.(\s|$)"
WORD = r"[\p{L}\p{N}]+(?:[''’\-.,:/][\p{L}\p{N}]+)*"


def sentence_list(text: str) -> str:
    masked = rf"regexp_replace({text}, '{_ABBR}', '\1' || chr(2) || '\2', 'g')"
    marked = rf"regexp_replace({masked}, '([.!?])(\s|$)', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(regexp_replace(replace(s, chr(2), '.'), '\s+', ' ', 'g'))), lambda s: s <> '')"


def sentences(source: str = EN, keys: str = "doc_id") -> str:
    return f"SELECT {keys}, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_index FROM (SELECT {keys}, {sentence_list('text')} AS ss FROM {source})"


def spelled(word: str) -> str:
    base = f"string_split(replace(lower({word}), '’', ''''), '''')[1]"
    letters = f"regexp_replace({base}, '[^a-z]', '', 'g')"
    runs = f"(len(regexp_extract_all(regexp_replace({letters}, '^y', ''), '[aeiouy]+')) + CASE WHEN regexp_matches({letters}, '^y[^aeiouy]') THEN 1 ELSE 0 END)"
    less_e = f"({runs} - CASE WHEN {letters} LIKE '%e' AND {runs} > 1 AND NOT regexp_matches({letters}, '[^aeiouy]le$') THEN 1 ELSE 0 END)"
    return f"greatest(1, {less_e} - CASE WHEN {less_e} > 1 AND regexp_matches({letters}, '[^td]ed$') THEN 1 ELSE 0 END)"


def syllables(word: str) -> str:
    parts = rf"list_sum(list_transform(regexp_extract_all({word}, '[^\-./,:]+'), lambda p: {spelled('p')}))"
    return rf"CASE WHEN regexp_matches({word}, '[\-./,:]') AND regexp_matches({word}, '\p{{L}}') THEN {parts} ELSE {spelled(word)} END"


def round2(x: str) -> str:
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2)::DOUBLE"


def sentence_counts(normalize: bool = True, source: str = EN) -> str:
    figure = r"regexp_matches(word, '\p{Nd}')" if normalize else "false"
    return rf"""
SELECT doc_id, sentence_index, count(*) AS words, CAST(sum(n) AS BIGINT) AS syllables, CAST(sum(c) AS BIGINT) AS characters,
  count(*) FILTER (NOT figure AND n >= 3) AS polysyllables, count(*) FILTER (figure) AS figures
FROM (SELECT doc_id, sentence_index, figure, CASE WHEN figure THEN 1 ELSE {syllables('word')} END AS n,
    CASE WHEN figure THEN 3 ELSE length(regexp_replace(word, '[^\p{{L}}\p{{N}}]', '', 'g')) END AS c
  FROM (SELECT doc_id, sentence_index, word, {figure} AS figure FROM (
    SELECT doc_id, sentence_index, unnest(regexp_extract_all(sentence, '{WORD}')) AS word FROM ({sentences(source)}))))
GROUP BY doc_id, sentence_index"""


GRADES = ", ".join(
    f"{round2(v)} AS {k}"
    for k, v in {
        "flesch_kincaid": "0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE",
        "flesch_ease": "206.835::DOUBLE - 1.015::DOUBLE * words / sentences - 84.6::DOUBLE * syllables / words",
        "coleman_liau": "0.0588::DOUBLE * (100 * characters::DOUBLE / words) - 0.296::DOUBLE * (100 * sentences::DOUBLE / words) - 15.8::DOUBLE",
        "smog": "1.0430::DOUBLE * sqrt(polysyllables::DOUBLE * 30 / sentences) + 3.1291::DOUBLE",
        "fog": "0.4::DOUBLE * (words::DOUBLE / sentences + 100 * polysyllables::DOUBLE / words)",
        "ari": "4.71::DOUBLE * characters / words + 0.5::DOUBLE * words / sentences - 21.43::DOUBLE",
    }.items()
)
COUNTS = "words, syllables, characters, polysyllables, figures"


def sentence_grades() -> str:
    return f"SELECT doc_id, CAST(sentence_index AS INTEGER) AS sentence_index, {COUNTS}, {GRADES} FROM (SELECT *, 1 AS sentences FROM ({sentence_counts()}))"


def readable(source: str = EN) -> str:
    from glossa.operators.readability import NOT_READ

    text = "text"
    for pattern, left in NOT_READ:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{left.replace('$', chr(92))}', 'g')"
    return f"(SELECT * REPLACE ({text} AS text) FROM {source})"


def document_grades(normalize: bool = True, source: str = EN) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS.split(", "))
    return f"SELECT doc_id, sentences, {COUNTS}, {GRADES} FROM (SELECT doc_id, count(*) AS sentences, {sums} FROM ({sentence_counts(normalize, source)}) GROUP BY doc_id)"

# --- findings -------------------------------------------------------------------------------------


def severity(observed: str, threshold: str) -> str:
    ratio = f"(CASE WHEN {threshold} = 0 THEN {observed} ELSE {observed} / {threshold} END)"
    return f"CASE WHEN {ratio} >= 2 THEN 'high' WHEN {ratio} >= 1.35 THEN 'medium' ELSE 'low' END"


def rule(source: str, name: str, dimension: str, observed: str, threshold: float, penalty: str, level: str | None = None) -> str:
    return f"""SELECT doc_id, CAST(sentence_index AS INTEGER) AS sentence_index, 'LING-{name}-001' AS rule_id, '{dimension}' AS dimension, observed, threshold,
{level or severity('observed', 'threshold')} AS severity, CAST({penalty} AS DOUBLE) AS penalty
FROM (SELECT *, CAST({observed} AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold FROM ({source})) WHERE observed > threshold"""


def capped(most: float, each: float) -> str:
    return f"least({most}, (observed - threshold) * {each})"


def _chars(characters: str, column: str = "sentence") -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def lowered_words(column: str = "sentence") -> str:
    return f"list_transform(regexp_extract_all({column}, '{WORD}'), lambda w: lower(w))"


def sentence_rules(profile) -> list[str]:
    t, s = profile.thresholds, sentences()
    w = f"SELECT *, {lowered_words()} AS w FROM ({s})"
    depth = f"2 * ({_chars('()[]')} // 2) + 2 * {_chars(';')} + {_chars('—–')} + greatest(0, {_chars(',')} - 2)"
    one = "CASE WHEN length(x) > 4 THEN regexp_replace(x, 's$', '') ELSE x END"
    excluded, named = (quoted(profile.words(k)) for k in ("nominalization_exclusions", "nominalizations"))
    ending = "(?:" + "|".join(profile.words("nominalization_suffixes")) + ")$"
    nominal = f"""len(list_filter(w, lambda x: x NOT IN ({excluded}) AND {one} NOT IN ({excluded})
  AND (x IN ({named}) OR {one} IN ({named}) OR regexp_matches({one}, '{ending}'))))"""
    items = r"CASE WHEN contains(sentence, ',') THEN len(list_filter(regexp_split_to_array(sentence, ',| and | or '), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) ELSE 0 END"
    return [
        rule(w, "SENTENCE", "sentence_load", "len(w)", t["max_sentence_words"], capped(30, 1.5)),
        rule(s, "PUNCTUATION", "sentence_load", depth, t["max_punctuation_depth"], capped(14, 2)),
        rule(w, "NOMINALIZATION", "morphology", nominal, t["max_nominalizations_per_sentence"], capped(25, 5)),
        rule(s, "LIST", "structure", items, t["max_inline_list_items"], capped(12, 2)),
    ]


def hyphen_terms() -> str:
    terms = rf"SELECT doc_id, sentence_index, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)+')) AS term FROM ({sentences()})"
    return f"SELECT *, CAST(len(string_split(term, '-')) AS INTEGER) AS parts FROM ({terms})"


def compound_rules(profile) -> list[str]:
    terms = f"SELECT * FROM ({hyphen_terms()}) WHERE term NOT IN ({quoted(profile.words('allowed_compounds'))})"
    most = profile.thresholds["max_compound_parts"]
    plain = f"SELECT * FROM ({terms}) WHERE parts <= {most} AND (parts >= 3 OR string_split(term, '-')[-1] IN ({quoted(profile.words('compound_modifier_suffixes'))}))"
    return [
        rule(terms, "COMPOUND-DEPTH", "morphology", "parts", most, capped(10, 3)),
        rule(plain, "COMPOUND", "lexical_clarity", "parts", 0, "CASE WHEN parts >= 3 THEN 6 ELSE 4 END", "CASE WHEN parts >= 3 THEN 'medium' ELSE 'low' END"),
    ]


def acronym_rule(profile) -> str:
    defined = rf"SELECT doc_id, unnest(regexp_extract_all(text, '\(([A-Z]{{2,8}})s?\)', 1)) AS acronym FROM {EN}"
    used = rf"SELECT doc_id, sentence_index, unnest(regexp_extract_all(sentence, '\b([A-Z]{{2,8}})s?\b', 1)) AS acronym FROM ({sentences()})"
    counted = f"""SELECT doc_id, sentence_index, count(*) AS n FROM ({used}) u WHERE acronym NOT IN ({quoted(profile.rules['known_acronyms'])})
AND NOT EXISTS (SELECT 1 FROM ({defined}) d WHERE d.doc_id = u.doc_id AND d.acronym = u.acronym) GROUP BY doc_id, sentence_index"""
    return rule(counted, "ABBREVIATION", "lexical_clarity", "n", profile.thresholds["max_undefined_acronyms_per_sentence"], capped(12, 3))


def paragraphs() -> str:
    return rf"SELECT doc_id, unnest(p) AS paragraph, generate_subscripts(p, 1) - 1 AS paragraph_index, NULL AS sentence_index FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM {EN})"


def paragraph_rule(profile) -> str:
    return rule(paragraphs(), "STRUCTURE", "structure", f"len(regexp_extract_all(paragraph, '{WORD}'))", profile.thresholds["max_paragraph_words"], capped(20, 0.75))


def repeated_words_rule(profile) -> str:
    from glossa.sources import profiles as P

    keys = "doc_id, word" if profile.flag("count_repetition_across_blocks") else "doc_id, paragraph_index, word"
    counted = rf"""SELECT {keys}, count(*) AS n, NULL AS sentence_index FROM (SELECT doc_id, paragraph_index, unnest({lowered_words('paragraph')}) AS word FROM ({paragraphs()}))
WHERE length(word) >= 7 AND word NOT IN ({quoted(P.STOP_LEMMAS)}) AND regexp_matches(word, '^\p{{L}}+$') GROUP BY {keys}"""
    return rule(counted, "REDUNDANCY", "redundancy", "n", profile.thresholds["max_repeated_content_word"], capped(10, 2), "'low'")


def phrase_counts(phrases: dict) -> str:
    lemma = "CASE WHEN w IN ('am', 'is', 'are', 'was', 'were', 'been', 'being') THEN 'be' WHEN w IN ('has', 'had', 'having') THEN 'have' ELSE w END"
    line = f"' ' || coalesce(array_to_string(list_transform({lowered_words()}, lambda w: {lemma}), '  '), '') || ' '"
    table = ", ".join(f"('{k}', '{p}')" for k, ps in sorted(phrases.items()) for p in ps)
    spaced = "' ' || replace(phrase, ' ', '  ') || ' '"
    return f"""SELECT * FROM (SELECT doc_id, CAST(sentence_index AS INTEGER) AS sentence_index, label, phrase,
  CAST((length(line) - length(replace(line, {spaced}, ''))) // length({spaced}) AS INTEGER) AS n
  FROM (SELECT doc_id, sentence_index, {line} AS line FROM ({sentences()})), (VALUES {table}) t(label, phrase)) WHERE n > 0"""


def filler_rule(phrases: dict) -> str:
    return rule(f"SELECT doc_id, sentence_index, unnest(range(n)) AS k FROM ({phrase_counts(phrases)})", "FILLER", "redundancy", "1", 0, "4", "'medium'")


def qualifier_rule(profile) -> str:
    w = f"SELECT doc_id, sentence_index, list_transform({lowered_words()}, lambda w: w IN ({quoted(profile.words('qualifiers'))})) AS q FROM ({sentences()})"
    n = f"SELECT *, len(list_filter(q, lambda x: x)) AS n, len(list_filter(range(1, len(q)), lambda i: q[i] AND q[i + 1])) > 0 AS s FROM ({w})"
    pair = rule(f"SELECT * FROM ({n}) WHERE s", "QUALIFIER", "redundancy", "n", 1, "5", "'medium'")
    many = rule(f"SELECT * FROM ({n}) WHERE NOT s AND n >= 2", "QUALIFIER", "redundancy", "n", profile.thresholds["max_qualifiers_per_sentence"], capped(10, 3))
    return f"{pair} UNION ALL {many}"


def findings(profile) -> str:
    return " UNION ALL ".join([*sentence_rules(profile), *compound_rules(profile), acronym_rule(profile), paragraph_rule(profile), repeated_words_rule(profile), filler_rule(profile.phrases('filler_phrases')), qualifier_rule(profile)])


def components(profile) -> str:
    weights = ", ".join(f"('{d}', {w})" for d, w in profile.weights.items())
    raw = round2("100 * pow(2, -deducted_points / 50)")
    return f"""SELECT *, {round2('raw_score * weight / 100')} AS weighted_contribution FROM (SELECT *, {raw} AS raw_score FROM (
SELECT d.doc_id, dimension, weight, coalesce(points, 0.0)::DOUBLE AS deducted_points FROM (SELECT doc_id, dimension, weight FROM {EN}, (VALUES {weights}) t(dimension, weight)) d
LEFT JOIN (SELECT doc_id, dimension, {round2('sum(penalty)')} AS points FROM ({findings(profile)}) GROUP BY ALL) p USING (doc_id, dimension)))"""


def scores(profile) -> str:
    bands = " ".join(f"WHEN value BETWEEN {lo} AND {hi} THEN '{b}'" for b, lo, hi in profile.bands)
    return f"SELECT *, CASE {bands} END AS band FROM (SELECT doc_id, {round2('sum(weighted_contribution)')} AS value FROM ({components(profile)}) GROUP BY doc_id)"


def duplicated_framing(blocks: str, profile) -> str:
    from glossa.sources import profiles as P

    t = profile.thresholds
    terms = f"list_distinct(list_filter({lowered_words('text')}, lambda w: length(w) >= 4 AND w NOT IN ({quoted(P.STOP_LEMMAS)})))"
    return f"""WITH listed AS (SELECT *, sum(CASE WHEN kind = 'list_item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index) AS items FROM ({blocks})),
short AS (SELECT doc_id, block_index, items, {terms} AS terms FROM listed WHERE kind = 'prose' AND len(regexp_extract_all(text, '{WORD}')) <= {t['max_duplicate_framing_words']}),
pairs AS (SELECT b.doc_id, b.block_index, a.block_index AS earlier, len(list_intersect(a.terms, b.terms)) AS shared, least(len(a.terms), len(b.terms)) AS smaller
FROM short a JOIN short b ON a.doc_id = b.doc_id AND a.block_index < b.block_index AND b.block_index - a.block_index <= {t['max_duplicate_framing_block_distance']} AND b.items > a.items)
SELECT doc_id, block_index, min(earlier) AS earlier, CAST(arg_min(shared, earlier) AS INTEGER) AS shared FROM pairs
WHERE shared >= {t['min_duplicate_framing_shared_terms']} AND shared / smaller >= {t['min_duplicate_framing_similarity']} GROUP BY ALL"""
