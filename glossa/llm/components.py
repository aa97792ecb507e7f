"""Connected components of a graph given as an edge table: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node that can be reached. Only nodes that have edges are listed.

    Each round takes the least label over a node's neighbours, combined before the shuffle so that a
    node with very many neighbours costs one row a task, and then jumps to the label's label. Rounds
    end when no label changes; the driver sees only that count. Each round is a written table.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).filter("u <> v").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        labels = materialize(jumped, "labels")
        if labels.filter("label <> old").limit(1).count() == 0:
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def contracted(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) as ``components`` has it, for graphs with many more edges than nodes.

    Each round points every node at its least neighbour, follows these pointers three times and replaces
    nodes by where they lead; edges inside a merged node go, equal ones collapse. So each edge is joined in the first
    round alone. A node leads to one of its own component, and the least of a component to itself.
    """
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    total = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        leads = materialize(ends.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")), "leads")
        for _ in range(3):
            leads = materialize(leads.join(leads.toDF("to", "further"), "to").select("node", F.col("further").alias("to")), "leads")
        if total is None:
            total = leads.toDF("node", "label")
        else:
            total = total.join(leads.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        total = materialize(total, "labels")
        moved = left.join(leads.toDF("a", "x"), "a").join(leads.toDF("b", "y"), "b").filter("x <> y")
        left = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if left.limit(1).count() == 0:
            return total
