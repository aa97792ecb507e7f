"""The weighted readability score of a document, from its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources.profiles import DIMENSIONS, Profile


def raw_score(deducted: Column) -> Column:
    return F.round(100 * F.pow(F.lit(2.0), -F.round(deducted, 2) / 50), 2)


def components(docs: DataFrame, findings: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, dimension, weight, deducted_points, raw_score, weighted_contribution): six rows a document."""
    six = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(profile.weights[d]).alias("weight")) for d in DIMENSIONS]))
    points = findings.groupBy("doc_id", "dimension").agg(F.round(F.sum("penalty"), 2).alias("deducted_points"))
    rows = docs.select("doc_id", six.alias("d")).select("doc_id", "d.*").join(points, ["doc_id", "dimension"], "left").fillna(0.0, ["deducted_points"])
    rows = rows.withColumn("raw_score", raw_score(F.col("deducted_points")))
    return rows.withColumn("weighted_contribution", F.round(F.col("raw_score") * F.col("weight") / 100, 2))


def band(value: Column, profile: Profile) -> Column:
    """The first band that holds the value; an error if none does."""
    out = None
    for name, low, high in profile.bands:
        inside = value.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.raise_error(F.lit("no band holds the score")))


def scores(parts: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, value, band) from components."""
    total = parts.groupBy("doc_id").agg(F.round(F.sum("weighted_contribution"), 2).alias("value"))
    return total.withColumn("band", band(F.col("value"), profile))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings of each document by severity, place and rule."""
    level = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.partitionBy("doc_id").orderBy(level, "sentence_index", "rule_id", "observed", "penalty")
    return findings.withColumn("rank", F.row_number().over(order).cast("long"))
