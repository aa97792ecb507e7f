"""What a rewrite must keep: protected items of a text with their places, and the digest of all of them.

Quantities, modals, negations and governance terms are column expressions over one reading; patterns and a policy's
concepts are found by one Arrow function over the text. An item that lies inside one of an earlier kind is not
counted again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import meaning as M
from glossa.operators import stemming
from glossa.operators.reading import by_text, read
from glossa.sources.profiles import Profile, load_profile

# Units, comparisons by number of words, modal names, negations of their own, governance terms.
UNITS = "% day days hour hours kg kgs kilogram kilograms lb lbs minute minutes month months pound pounds second seconds week weeks year years".split()
COMPARISONS = {3: ["no less than", "no more than"], 2: ["at least", "at most", "fewer than", "less than", "more than", "> =", "< ="], 1: ["over", "under", ">", "<"]}
MODALS = {"must": "must", "shall": "must", "should": "should", "may": "may", "will": "will", "would": "would", "could": "could", "can": "can"}
NEGATIONS = ["no", "without", "neither", "nor", "never"]
GOVERNANCE = ["applicability", "approval", "approve", "cutover", "decision", "provisional", "ratification", "ratify", "recommendation", "risk", "waiver"]
# End of the fixed values.
ITEM = "struct<kind: string, item: string, normalized: string, start: int, end: int>"


def _patterns(text: Column, profile: Profile) -> Column:
    """array<ITEM> of the fixed patterns and of the policy's concepts."""
    known = [(kind, re.compile(p), None) for kind, p in M.PATTERNS.items()]
    known += [(f"concept:{c['kind']}", re.compile(p, re.IGNORECASE), c["value"]) for c in profile.rules.get("protected_concepts", []) for p in c["patterns"]]

    def found(t: str) -> list[dict]:
        out, covered = [], bytearray(len(t))
        for kind, pattern, value in known:
            hits = [m for m in pattern.finditer(t) if m.end() > m.start() and not covered[m.start()]]
            out += [{"kind": kind, "item": m[0], "normalized": value or (m[0].upper() if kind == "identifier" else m[0]), "start": m.start(), "end": m.end()} for m in hits]
            for m in hits:
                covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
        return out

    return by_text(found, f"array<{ITEM}>", text)


def _item(kind: str, text: Column, normalized: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.substr(text, start + 1, end - start).alias("item"), normalized.alias("normalized"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _quantities(s: Column, text: Column) -> Column:
    """Numbers, with the comparison before and the unit after them."""
    tokens = s["tokens"]

    def placed(t: Column) -> Column:
        start = t["start"]
        for n, words in sorted(COMPARISONS.items()):  # the longest comparison wins, as it is tried last
            before = F.array_join(F.transform(F.slice(tokens, F.greatest(t["i"] - n + 1, F.lit(1)), n), lambda x: x["low"]), " ")
            start = F.when((t["i"] >= n) & X.among(before, words), F.get(tokens, t["i"] - n)["start"]).otherwise(start)
        after = F.get(tokens, t["i"] + 1)
        end = F.when(X.among(after["low"], UNITS), after["end"]).otherwise(t["end"])
        shown = F.regexp_replace(F.substr(text, start + 1, end - start), r"([<>])\s+=", "$1=")
        return _item("quantity", text, M.quantity(F.regexp_replace(shown, r"\s+", " ")), start, end)

    return F.transform(F.filter(tokens, lambda t: (t["pos"] == "NUM") | X.among(t["low"], [*M.NUMBERS, "either"])), placed)


def _modals(s: Column, text: Column) -> Column:
    """Modal auxiliaries; with the negation of the same verb, if it has one."""
    tokens = s["tokens"]
    names = F.create_map(*[F.lit(x) for kv in MODALS.items() for x in kv])

    def placed(t: Column) -> Column:
        head = F.get(tokens, t["head"])
        negation = F.get(F.filter(tokens, lambda c: (c["dep"] == "neg") & (c["head"] == head["i"]) & (F.abs(c["i"] - t["i"]) <= 2)), 0)
        name = names[t["lemma"]]
        denied = F.when(t["lemma"] == "can", F.lit("cannot")).otherwise(F.concat(name, F.lit(" not")))
        one_word = t["low"] == "cannot"
        near = negation.isNotNull()
        start, end = F.when(near, F.least(t["start"], negation["start"])).otherwise(t["start"]), F.when(near, F.greatest(t["end"], negation["end"])).otherwise(t["end"])
        return _item("modal", text, F.when(near | one_word, denied).otherwise(name), start, end)

    return F.transform(F.filter(tokens, lambda t: (t["pos"] == "AUX") & names[t["lemma"]].isNotNull()), placed)


def _negations(s: Column, text: Column) -> Column:
    hits = F.filter(s["tokens"], lambda t: (t["dep"] == "neg") | X.among(t["low"], NEGATIONS))
    return F.transform(hits, lambda t: _item("negation", text, F.when(X.among(t["low"], NEGATIONS), t["low"]).otherwise("not"), t["start"], t["end"]))


def _governance(s: Column, text: Column) -> Column:
    """Governance terms by the stem of their action, so that a noun and its verb are one."""
    hits = F.filter(s["tokens"], lambda t: X.among(t["lemma"], GOVERNANCE))
    return F.transform(hits, lambda t: _item("governance", text, stemming.stem(t["lemma"]), t["start"], t["end"]))


def _joined(have: Column, new: Column) -> Column:
    """``have``, and of ``new`` what lies in none of it."""
    return F.concat(have, F.filter(new, lambda x: ~F.exists(have, lambda h: (h["start"] <= x["start"]) & (x["end"] <= h["end"]))))


def protected(docs: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, items): array<ITEM> of each text, in order of kind and place; a null text has none."""
    rows = read(docs.select("doc_id", "text")).withColumn("items", _patterns(F.col("text"), profile or load_profile()))
    for make in (_quantities, _modals, _negations, _governance):
        rows = rows.withColumn("_found", _of_sentences(make)).withColumn("items", _joined(F.col("items"), F.col("_found")))
    return rows.select("doc_id", "items")


def _of_sentences(make) -> Column:
    return F.flatten(F.transform("reading.sentences", lambda s: make(s, F.col("text")))).cast(f"array<{ITEM}>")


def manifest(docs: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, n_items, counts by kind, sha256): equal digests mean that the same things are protected the same number of times."""
    rows = protected(docs, profile)
    listed = F.array_sort(F.transform("items", lambda x: F.concat_ws("\t", x["kind"], x["normalized"])))
    count = lambda kind: F.size(F.filter("items", lambda x: x["kind"] == kind)).cast("long")
    kinds = ["url", "code", "citation", "identifier", "quantity", "modal", "negation", "governance"]
    return rows.select("doc_id", F.size("items").cast("long").alias("n_items"), *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(F.encode(F.array_join(listed, "\n"), "UTF-8"), 256).alias("sha256"))
