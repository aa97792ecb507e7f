"""What several operators share: the shared folder, written intermediate tables, batches of texts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.deploy import ship

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset.

    Only a local session, whose executors are the driver, may go without: elsewhere it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = got.get() if got.isDefined() else None
    if path is None:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='glossa-shared-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove_made() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a replicated place, so that a lost executor costs nothing before it,
    and gives the planner the table's true size for its choice of joins.
    """
    ship(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by number, and the new name of each: no name can clash with added ones."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def renamed_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what Python objects hold at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``most_bytes`` of a text column each, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most_bytes
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for first, last in zip(edge, edge[1:], strict=False):
            if last > first:
                yield batch.slice(first, last - first)


def lean(run):
    """``run`` (batches to batches), after which the worker gives freed memory back: workers serve many stages."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return kept


def id_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus
