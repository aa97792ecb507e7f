"""Claims of a text from annotated tokens: who must, or must not, do what to what.

Each verb that states something is a claim with actor, action, target, modality and polarity. Roles are
equi-joins of the token table with itself on (doc_id, head); phrases are a noun and its modifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as X
from glossa.operators import meaning as M
from glossa.operators import stemming
from glossa.operators.annotate import annotate, tokens
from glossa.operators.reading import by_text

# Synonyms of actions, verbs that claim nothing, modal names, number words.
SAME_ACTION = {"address": "resolve", "fix": "resolve", "remediate": "resolve", "mention": "note", "observe": "note", "start": "begin"}
NOT_CLAIMS = ["propose", "treat", "use"]
MODALS = {"must": "must", "shall": "must", "should": "should", "may": "may", "will": "will", "would": "would", "could": "could", "can": "can", "cannot": "can"}
ORDER = {"before": "before", "prior": "before", "until": "before", "after": "after", "following": "after", "once": "after"}
# End of the fixed values.
FIELDS = ["action", "actor", "modality", "polarity", "status", "target"]


def _map(values: dict[str, str], key) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def phrases(toks: DataFrame) -> DataFrame:
    """(doc_id, index, phrase): the lemmas of each noun's modifiers in order of the alphabet, then its own; numbers as digits."""
    number = F.coalesce(_map(M.NUMBERS, F.col("lemma")), F.col("lemma"))
    parts = toks.filter(F.col("dep").isin("compound", "amod", "nummod") & (F.col("head") != F.col("index"))).select("doc_id", F.col("head").alias("index"), number.alias("part"))
    before = parts.groupBy("doc_id", "index").agg(F.array_sort(F.collect_list("part")).alias("before"))
    nouns = toks.filter(F.col("pos").isin("NOUN", "PROPN", "PRON", "NUM")).select("doc_id", "index", number.alias("own"))
    joined = nouns.join(before, ["doc_id", "index"], "left")
    return joined.select("doc_id", "index", F.concat_ws(" ", F.coalesce("before", F.array().cast("array<string>")), F.array("own")).alias("phrase"))


def claims(toks: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, index, actor, action, target, modality, polarity, status)."""
    named = phrases(toks)
    child = lambda deps: toks.filter(F.col("dep").isin(deps) & (F.col("head") != F.col("index")))

    def role(deps: list[str], name: str) -> DataFrame:
        rows = child(deps).select("doc_id", F.col("head").alias("verb"), "index").join(named, ["doc_id", "index"])
        return rows.groupBy("doc_id", F.col("verb").alias("index")).agg(F.array_join(F.array_sort(F.collect_list("phrase")), ",").alias(name))

    by = child(["agent"]).select("doc_id", F.col("head").alias("verb"), F.col("index").alias("by"))
    agents = by.join(child(["pobj"]).select("doc_id", F.col("head").alias("by"), "index"), ["doc_id", "by"]).join(named, ["doc_id", "index"])
    agents = agents.groupBy("doc_id", F.col("verb").alias("index")).agg(F.min("phrase").alias("agent"))
    first = toks.groupBy("doc_id", "sentence_index").agg(F.min("index").alias("first"))
    helpers = child(["aux", "neg"]).groupBy("doc_id", F.col("head").alias("index")).agg(
        F.max(_map(MODALS, F.col("lemma"))).alias("modal"), F.max(F.when(F.col("dep") == "neg", 1).otherwise(0)).alias("negated"), F.min("index").alias("from")
    )
    verbs = toks.filter((F.col("pos") == "VERB") & ~F.col("lemma").isin(NOT_CLAIMS) & ~F.col("dep").isin("amod", "acomp")).select("doc_id", "sentence_index", "index", "lemma", "dep", "head")
    rows = verbs.join(first, ["doc_id", "sentence_index"])
    for more in (role(["nsubj"], "subject"), role(["nsubjpass"], "passive"), role(["dobj", "attr"], "object"), agents, helpers):
        rows = rows.join(more, ["doc_id", "index"], "left")
    governor = rows.select("doc_id", F.col("index").alias("head"), F.coalesce("agent", "subject").alias("governing"), F.col("modal").alias("governing_modal"))
    rows = rows.join(governor, ["doc_id", "head"], "left")
    joined = F.col("dep") == "conj"
    imperative = F.coalesce(F.col("from"), F.col("index")) == F.col("first")
    action = F.coalesce(_map(SAME_ACTION, F.col("lemma")), F.col("lemma"))
    return rows.select(
        "doc_id", "sentence_index", "index",
        F.coalesce("agent", "subject", F.when(joined & F.col("passive").isNull(), F.col("governing")), F.lit("unspecified")).alias("actor"),
        stemming.stem(action).alias("action"), F.coalesce("passive", "object", F.lit("unspecified")).alias("target"),
        F.coalesce("modal", F.when(joined, F.col("governing_modal")), F.when(imperative & F.col("subject").isNull() & F.col("passive").isNull(), "must"), F.lit("none")).alias("modality"),
        F.when(F.col("negated") == 1, "negative").otherwise("positive").alias("polarity"), F.lit("asserted").alias("status"),
    )


CLAIM = "array<struct<index: int, actor: string, action: string, target: string, modality: string, polarity: string>>"


def sentence_claims(sentence: str) -> list[dict]:
    """What ``claims`` finds in one sentence, whose roles never leave it; the action is not stemmed yet."""
    toks = annotate(sentence)
    number = lambda t: str(M.NUMBERS.get(t["lemma"], t["lemma"]))
    kids: dict[int, list[dict]] = {}
    for t in toks:
        if t["head"] != t["index"]:
            kids.setdefault(t["head"], []).append(t)

    def phrase(t: dict) -> str | None:
        if t["pos"] not in ("NOUN", "PROPN", "PRON", "NUM"):
            return None
        return " ".join([*sorted(number(c) for c in kids.get(t["index"], ()) if c["dep"] in ("compound", "amod", "nummod")), number(t)])

    def named(head: int, *deps: str) -> list[str]:
        return sorted(p for c in kids.get(head, ()) if c["dep"] in deps and (p := phrase(c)) is not None)

    rows = {}
    for t in toks:
        if t["pos"] != "VERB" or t["lemma"] in NOT_CLAIMS or t["dep"] in ("amod", "acomp"):
            continue
        v = t["index"]
        helpers = [c for c in kids.get(v, ()) if c["dep"] in ("aux", "neg")]
        rows[v] = {
            "lemma": t["lemma"], "joined": t["dep"] == "conj", "head": t["head"], "from": min((c["index"] for c in helpers), default=v),
            **{k: ",".join(named(v, *deps)) or None for k, deps in (("subject", ("nsubj",)), ("passive", ("nsubjpass",)), ("object", ("dobj", "attr")))},
            "agent": min((p for c in kids.get(v, ()) if c["dep"] == "agent" for p in named(c["index"], "pobj")), default=None),
            "modal": max((MODALS[c["lemma"]] for c in helpers if c["lemma"] in MODALS), default=None), "negated": any(c["dep"] == "neg" for c in helpers),
        }
    out = []
    for v, r in rows.items():
        above = rows.get(r["head"]) if r["joined"] else None
        governing, modal = ((above["agent"] or above["subject"]) if r["passive"] is None else None, above["modal"]) if above else (None, None)
        ordered = "must" if r["from"] == 0 and r["subject"] is None and r["passive"] is None else "none"
        out.append({
            "index": v, "actor": r["agent"] or r["subject"] or governing or "unspecified", "action": SAME_ACTION.get(r["lemma"], r["lemma"]), "target": r["passive"] or r["object"] or "unspecified",
            "modality": r["modal"] or modal or ordered, "polarity": "negative" if r["negated"] else "positive",
        })
    return out


def claims_of(sent: DataFrame) -> DataFrame:
    """``claims`` of the annotated tokens of (doc_id, sentence_index, sentence): annotated once, without a join or shuffle."""
    rows = sent.select("doc_id", "sentence_index", F.explode(by_text(sentence_claims, CLAIM, F.col("sentence"))).alias("c"))
    return rows.select(
        "doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), (F.col("sentence_index").cast("long") * 1_000_000 + F.col("c.index")).alias("index"),
        "c.actor", stemming.stem(F.col("c.action")).alias("action"), "c.target", "c.modality", "c.polarity", F.lit("asserted").alias("status"),
    )


def order_signatures(toks: DataFrame) -> DataFrame:
    """(doc_id, signature) of what comes before what: marker with its noun against the governing verb's."""
    named = phrases(toks)
    marks = toks.withColumn("way", _map(ORDER, F.col("lemma"))).filter("way IS NOT NULL AND dep IN ('prep', 'mark')").select("doc_id", F.col("index").alias("mark"), F.col("head").alias("verb"), "way")
    inner = toks.filter("dep = 'pobj'").select("doc_id", F.col("head").alias("mark"), "index").join(named, ["doc_id", "index"]).select("doc_id", "mark", F.col("phrase").alias("anchor"))
    outer = toks.filter("dep IN ('dobj', 'nsubjpass')").select("doc_id", F.col("head").alias("verb"), "index").join(named, ["doc_id", "index"]).select("doc_id", "verb", F.col("phrase").alias("event"))
    rows = marks.join(inner, ["doc_id", "mark"]).join(outer, ["doc_id", "verb"])
    early = F.when(F.col("way") == "before", F.col("event")).otherwise(F.col("anchor"))
    late = F.when(F.col("way") == "before", F.col("anchor")).otherwise(F.col("event"))
    return rows.select("doc_id", F.concat(F.lit("order:earlier="), early, F.lit(";later="), late).alias("signature"))


def compare_texts(pairs: DataFrame) -> DataFrame:
    """(pair_id, disposition, missing, added, specified) of (pair_id, source, candidate).

    A source claim without an actor is met by a candidate's that names one, never the other way round.
    """
    sides = pairs.select("pair_id", F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("candidate"), F.col("candidate"))).alias("side", "text"))
    docs = sides.select(F.struct("pair_id", "side").alias("doc_id"), "text")
    toks = tokens(X.sentences(docs, ["doc_id"]))
    found = claims(toks).select(F.col("doc_id.pair_id").alias("pair_id"), F.col("doc_id.side").alias("side"), "actor", "action", "target", "modality", "polarity", "status")
    other = [c for c in found.columns if c != "side"]
    source, candidate = found.filter("side = 'source'").select(*other), found.filter("side = 'candidate'").select(*other)
    met = M.reconciled_actors(source.exceptAll(candidate), candidate.exceptAll(source))
    signed = lambda df, side: df.select("pair_id", F.lit(side).alias("side"), M.claim_signature({k: k for k in FIELDS}).alias("signature"))
    rest = signed(source.exceptAll(met.withColumn("actor", F.lit("unspecified")).select(*other)), "source").unionByName(signed(candidate.exceptAll(met.select(*other)), "candidate"))
    orders = order_signatures(toks).select(F.col("doc_id.pair_id").alias("pair_id"), F.col("doc_id.side").alias("side"), "signature")
    difference = M.multiset_difference(rest.unionByName(orders))
    doubts = M.polarity_conflicts(source).unionByName(M.polarity_conflicts(candidate))
    lists = difference.groupBy("pair_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.col("signature")))), " | ").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("added") > 0, F.col("signature")))), " | ").alias("added")
    )
    specified = met.groupBy("pair_id").agg(F.count("*").alias("specified"))
    out = M.dispositions(pairs, difference, doubts).join(lists, "pair_id", "left").join(specified, "pair_id", "left")
    return out.select("pair_id", "disposition", F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("added", F.lit("")).alias("added"), F.coalesce("specified", F.lit(0)).cast("long").alias("specified"))
