"""Rules over annotated tokens.

``tokens`` has (doc_id, sentence_index, index, text, lemma, pos, dep, head); ``head`` is the index of the
governing token, its own for a root. Every rule is a semi-join or a grouped count on (doc_id, head).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the annotation scheme and the rules.
SUBJECTS = ["nsubj", "nsubjpass", "csubj", "csubjpass"]
PASSIVE = ["auxpass", "nsubjpass", "csubjpass"]
CLAUSAL = ["advcl", "ccomp", "relcl", "xcomp"]
NOT_HEADS = ["aux", "auxpass", "amod", "acomp"]
OBLIGATION = ["must", "shall", "should"]
IMPERSONAL = ["it", "there"]
ABSTRACT = ["approval", "assessment", "closure", "decision", "evidence", "implementation", "migration", "ratification", "recommendation", "remediation", "resolution", "validation", "verification"]
# End of the fixed values.

KEY = ["doc_id", "sentence_index"]


def children(tokens: DataFrame, deps: list[str]) -> DataFrame:
    """(doc_id, index, child, child_lemma) of the children with one of the relations."""
    own = tokens.filter(F.col("dep").isin(deps) & (F.col("head") != F.col("index")))
    return own.select("doc_id", F.col("head").alias("index"), F.col("index").alias("child"), F.col("lemma").alias("child_lemma"))


def passive_verbs(tokens: DataFrame) -> DataFrame:
    verbs = tokens.filter((F.col("pos") == "VERB") & ~F.col("dep").isin("amod", "acomp"))
    return verbs.join(children(tokens, PASSIVE), ["doc_id", "index"], "left_semi").select(*KEY, "index", "lemma")


def agentless_decisions(tokens: DataFrame) -> DataFrame:
    """Passives without an agent, under an obligation or with an impersonal or abstract subject."""
    bare = passive_verbs(tokens).join(children(tokens, ["agent"]), ["doc_id", "index"], "left_anti")
    bound = children(tokens, ["aux"]).filter(F.col("child_lemma").isin(OBLIGATION))
    vague = children(tokens, SUBJECTS).filter(F.col("child_lemma").isin(IMPERSONAL + ABSTRACT))
    return bare.join(bound.unionByName(vague).select("doc_id", "index").distinct(), ["doc_id", "index"], "left_semi").select(*KEY, "index", "lemma")


def sentence_loads(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, actions, clauses): verb heads, and one more than clausal verbs."""
    verb_heads = tokens.select("doc_id", F.col("index").alias("head"), F.lit(True).alias("under_verb")).filter(F.col("under_verb")).join(
        tokens.filter(F.col("pos") == "VERB").select("doc_id", F.col("index").alias("head")), ["doc_id", "head"], "left_semi"
    )
    rows = tokens.join(verb_heads, ["doc_id", "head"], "left")
    verb = F.col("pos") == "VERB"
    clausal = verb & (F.col("dep").isin(CLAUSAL) | ((F.col("dep") == "conj") & F.coalesce("under_verb", F.lit(False))))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy(*KEY).agg(one(verb & ~F.col("dep").isin(NOT_HEADS)).alias("actions"), (one(clausal) + 1).alias("clauses"))


def noun_stacks(tokens: DataFrame, least: int = 3) -> DataFrame:
    """Contiguous compound and adjective modifiers that end at their head noun: gaps and islands by index."""
    stacked = tokens.filter((F.col("pos").isin("NOUN", "PROPN", "ADJ")) & F.col("dep").isin("compound", "amod")).select(*KEY, "index")
    island = F.col("index") - F.row_number().over(Window.partitionBy(*KEY).orderBy("index"))
    length = F.row_number().over(Window.partitionBy(*KEY, "island").orderBy("index"))
    runs = stacked.withColumn("island", island).select(*KEY, (F.col("index") + 1).alias("root"), (length + 1).alias("depth")).filter(F.col("depth") >= least)
    heads = tokens.filter(F.col("pos").isin("NOUN", "PROPN") & ~F.col("dep").isin("compound")).select(*KEY, F.col("index").alias("root"), F.col("text").alias("head_text"))
    return runs.join(heads, [*KEY, "root"]).select(*KEY, "root", "head_text", "depth")


def subtree(tokens: DataFrame) -> DataFrame:
    """(doc_id, root, index): every token below each token, itself included.

    A sentence's heads meet in one row; each token's path to its root is a fold over them, so neither depth
    nor number of sentences has a limit and rows move once. A head that is not in the sentence ends a path.
    """
    heads = F.map_from_entries(F.collect_list(F.struct("index", "head"))).alias("up")
    each = tokens.groupBy(*KEY).agg(heads).select("doc_id", "up", F.explode(F.map_keys("up")).alias("index"))
    last = lambda path: F.element_at(path, -1)
    above = lambda path: F.col("up")[last(path)]
    ends = lambda path: F.coalesce((above(path) == last(path)) | ~F.map_contains_key("up", above(path)), F.lit(True))
    path = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.array("index"), lambda p, _: F.when(ends(p), p).otherwise(F.concat(p, F.array(above(p)))))
    return each.select("doc_id", F.explode(path).alias("root"), "index")
