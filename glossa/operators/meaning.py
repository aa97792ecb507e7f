"""Protected elements of a text, claim signatures and the comparison of two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Protected patterns, number words, units, operators.
PATTERNS = {
    "url": r"https?://[^\s<>()]+",
    "code": "`[^`\n]+`",
    "citation": r"\[[A-Za-z0-9_.:-]+\]|\([A-Za-z][A-Za-z .'-]+,\s*\d{4}\)",
    "identifier": r"\b(?:[A-Za-z]{2,}-\d+(?:-[A-Za-z0-9]+)*|[A-Z]\d+(?:\.\d+)*|[A-Z]{1,8}\d[A-Z0-9]*(?:-[A-Z0-9]+)*)\b",
}
NUMBERS = dict(zip("one two three four five six seven eight nine ten both".split(), "1 2 3 4 5 6 7 8 9 10 2".split(), strict=True))
OPERATORS = {
    "gte": ["at least", "no less than", ">="], "lte": ["at most", "no more than", "<="], "gt": ["more than", "over", ">"], "lt": ["less than", "fewer than", "under", "<"],
}
DURATIONS = ["second", "minute", "hour", "day", "week", "month", "year"]


def regex_items(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, kind, item, n): protected elements by pattern, counted."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("items")) for k, p in PATTERNS.items()])
    rows = docs.select(key, F.explode(found).alias("x")).select(key, "x.kind", F.explode("x.items").alias("item"))
    shown = F.when(F.col("kind") == "identifier", F.upper("item")).otherwise(F.col("item"))
    return rows.select(key, "kind", shown.alias("item")).groupBy(key, "kind", "item").agg(F.count("*").alias("n"))


def quantity(text: Column) -> Column:
    """Canonical form ``operator=..;unit=..;value=..`` of a quantity phrase; ``quantifier=either``; dates as they are."""
    low = F.lower(F.trim(text))
    sign = None
    for name, phrases in OPERATORS.items():
        for p in phrases:
            hit = low.startswith(p + " ") if p[0].isalpha() else low.startswith(p)
            if p in (">", "<"):
                hit = hit & ~low.startswith(p + "=")
            sign = F.when(hit, name) if sign is None else sign.when(hit, name)
    sign = sign.otherwise("eq")
    word = F.regexp_extract(low, r"\b(" + "|".join(NUMBERS) + r")\b", 1)
    digits = F.regexp_replace(F.regexp_extract(low, r"\d[\d,]*(?:\.\d+)?", 0), ",", "")
    named = F.lit("")
    for k, v in NUMBERS.items():
        named = F.when(word == k, v).otherwise(named)
    value = F.when(digits != "", digits).otherwise(named)
    last = F.regexp_extract(low, r"([a-z%]+)$", 1)
    one = F.regexp_replace(last, "s$", "")
    unit = (
        F.when(last.isin("%", "percent"), "percent").when(one.isin(DURATIONS), one)
        .when(last.isin("kg", "kgs", "kilogram", "kilograms"), "kg").when(last.isin("lb", "lbs", "pound", "pounds"), "lb").otherwise("")
    )
    shape = F.concat(F.lit("operator="), sign, F.when(unit != "", F.concat(F.lit(";unit="), unit)).otherwise(""), F.lit(";value="), value)
    return F.when(low.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.lit("date="), low)).when(low == "either", "quantifier=either").otherwise(shape)


def folded(phrase: Column) -> Column:
    """All words but the last in order of the alphabet, the last one last."""
    words = F.split(phrase, " ")
    n = F.size(words)
    return F.when(n < 3, F.array_join(F.when(n == 2, words).otherwise(words), " ")).otherwise(F.concat_ws(" ", F.array_sort(F.slice(words, 1, n - 1)), F.element_at(words, -1)))


def claim_signature(columns: dict[str, str]) -> Column:
    return F.concat(F.lit("claim:"), F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col(v)) for k, v in sorted(columns.items())]))


def multiset_difference(signatures: DataFrame) -> DataFrame:
    """(pair_id, signature, missing, added) from (pair_id, side, signature): counts that one side has more of."""
    side = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    both = signatures.groupBy("pair_id", "signature").agg(side("source").alias("a"), side("candidate").alias("b"))
    zero = F.lit(0)
    return both.select("pair_id", "signature", F.greatest(F.col("a") - F.col("b"), zero).cast("long").alias("missing"), F.greatest(F.col("b") - F.col("a"), zero).cast("long").alias("added")).filter("missing + added > 0")


def reconciled_actors(missing: DataFrame, added: DataFrame) -> DataFrame:
    """Claims whose unspecified actor the candidate names: (pair_id, action, target, modality, polarity, status, actor).

    Both sides have claim rows. Matching is one to one, in order of the named actor.
    """
    rest = ["pair_id", "action", "target", "modality", "polarity", "status"]
    number = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*rest).orderBy(by)))
    left = number(missing.filter(F.col("actor") == "unspecified"), "actor").select(*rest, "_n")
    right = number(added.filter(F.col("actor") != "unspecified"), "actor")
    return left.join(right, [*rest, "_n"]).select(*rest, "actor")


def polarity_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of one action with opposite polarity and the same, or an unclear, target."""
    a, b = claims.filter(F.col("polarity") == "positive").alias("a"), claims.filter(F.col("polarity") == "negative").alias("b")
    vague = ["it", "this", "that", "them", "these", "those", "unspecified"]
    same = (F.col("a.target") == F.col("b.target")) | F.col("a.target").isin(vague) | F.col("b.target").isin(vague)
    return a.join(b, (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.action") == F.col("b.action")) & same).select(
        F.col("a.pair_id").alias("pair_id"), F.col("a.action").alias("action"), F.col("a.target").alias("affirmed"), F.col("b.target").alias("denied")
    )


def dispositions(pairs: DataFrame, difference: DataFrame, doubts: DataFrame) -> DataFrame:
    """(pair_id, disposition): equal digests are equivalent; a doubt outweighs a change."""
    moved = difference.groupBy("pair_id").agg(F.sum(F.col("missing") + F.col("added")).alias("moved"))
    doubted = doubts.groupBy("pair_id").agg(F.count("*").alias("doubts"))
    joined = pairs.join(moved, "pair_id", "left").join(doubted, "pair_id", "left")
    equal = F.sha2("source", 256) == F.sha2("candidate", 256)
    what = F.when(equal, "equivalent").when(F.col("doubts") > 0, "unresolved").when(F.col("moved") > 0, "changed").otherwise("equivalent")
    return joined.select("pair_id", what.alias("disposition"))


def judged(pairs: DataFrame, growth_percent: float = 10, growth_words: int = 12, target_grade: float | None = None) -> DataFrame:
    """Accept or reject candidates, with the reasons in order.

    ``pairs`` has pair_id, disposition, source_value, candidate_value, source_words, candidate_words,
    source_high, candidate_high (arrays of rule ids of high severity). With ``target_grade`` it also has
    source_grade and candidate_grade; then the score may stay, and the grade must fall to the target.
    """
    allowed = F.col("source_words") + F.greatest(F.lit(growth_words), F.ceil(F.col("source_words") * growth_percent / 100))
    new = F.array_except("candidate_high", "source_high")
    if target_grade is None:
        scored = [F.when(F.col("candidate_value") <= F.col("source_value"), F.lit("score_not_improved"))]
    else:
        scored = [
            F.when(F.col("candidate_value") < F.col("source_value"), F.lit("score_regressed")), F.when(F.coalesce(F.col("candidate_grade") >= F.col("source_grade"), F.lit(True)), F.lit("grade_not_lowered")),
            F.when(F.coalesce(F.col("candidate_grade") > target_grade, F.lit(True)), F.lit("grade_over_target")),
        ]
    reasons = F.array(
        F.when(F.col("disposition") != "equivalent", F.concat(F.lit("meaning_"), F.col("disposition"))), *scored,
        F.when(F.size(new) > 0, F.lit("new_high_severity")), F.when(F.col("candidate_words") > allowed, F.lit("too_long")),
    )
    kept = F.filter(reasons, lambda r: r.isNotNull())
    return pairs.select("pair_id", (F.size(kept) == 0).alias("accepted"), F.array_join(kept, ",").alias("reasons"), allowed.cast("long").alias("allowed_words"))


def first_accepted(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(source_id, attempts, accepted_index, -1 for none): the loop over candidates ends at the first accepted one."""
    tried = attempts.filter(F.col("index") < most)
    first = tried.groupBy("source_id").agg(F.min(F.when(F.col("accepted"), F.col("index"))).alias("accepted_index"), F.count("*").alias("given"))
    return first.select("source_id", F.coalesce(F.col("accepted_index") + 1, F.col("given")).cast("long").alias("attempts"), F.coalesce("accepted_index", F.lit(-1)).alias("accepted_index"))
