"""Sharding by global byte-size prefix sums.

Documents are put in one total order (id, then checksum and size of the text). Ranges of that order
are sorted in parallel; each gives its total, the totals' prefix sums give each range's start, and a
running sum inside a range gives each document's global byte offset. Cutting that offset at equal
targets gives contiguous shards whose sizes differ from the target by less than the largest document.
Only (id, size, checksum) is shuffled, never a text; the totals are one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import materialize


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): size is the text's UTF-8 bytes (null: none) plus 1."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def with_global_offsets(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``byte_start``, ``row_start`` (exclusive prefix sums in the total order) and ``all_bytes``.

    Rows equal in all of ``order`` may stand in any order among themselves.
    """
    ranged = rows.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id())
    inside = Window.partitionBy("range_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = materialize(
        ranged.withColumn("_bytes", F.sum(size).over(inside) - F.col(size)).withColumn("_rows", F.row_number().over(Window.partitionBy("range_id").orderBy(*order)) - 1),
        "ranges",
    )
    totals = local.groupBy("range_id").agg(F.sum(size).alias("_size"), F.count("*").alias("_n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "range_id",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_r0"),
        F.sum("_size").over(Window.partitionBy()).alias("all_bytes"),
    )
    # one row for each range, so at most as many as there are partitions
    return local.join(F.broadcast(starts), "range_id").select(
        *[c for c in local.columns if c not in ("range_id", "_bytes", "_rows")],
        (F.col("_b0") + F.col("_bytes")).alias("byte_start"),
        (F.col("_r0") + F.col("_rows")).cast("long").alias("row_start"),
        "all_bytes",
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of near equal bytes: (doc_id, size, text_crc32, shard, slot, byte_start).

    A document goes where the middle of its bytes falls. Null ids come first; equal ids are ordered by
    checksum and size; repeated rows each get a slot; a null or empty text has size 1; an empty table
    gives no rows; other columns, whatever their names, are not read. A document larger than a target
    leaves some shard numbers unused rather than being split.
    """
    placed = with_global_offsets(sized(docs, id_col, text_col), ["doc_id", "text_crc32", "size"], "size")
    middle = F.col("byte_start") + F.expr("size div 2")
    placed = placed.withColumn("_middle", middle).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(_middle * {n_shards}L) div all_bytes")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row_start").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_start") - F.col("_first")).alias("slot"), "byte_start")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id") -> DataFrame:
    """Write every document into its shard's folder below ``path``, in slot order; returns the placement.

    Needs unique ids. The texts are shuffled once, to their shards; each shard may have several files.
    """
    placed = materialize(shard_by_bytes(docs, n_shards, id_col), "placed")
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = docs.select(*keep).join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
