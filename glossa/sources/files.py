"""Text and JSON sources and sinks of the engine, and the guards of their paths."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text, sha256): one document for each UTF-8 file; doc_id is a hash of the path."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def read_artifacts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON objects under a given schema; a file that does not fit is an error, not a null row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_syllables(spark: SparkSession, path: str) -> DataFrame:
    """(word, syllables) from a tab-separated table; where a word stands twice, the first count by value."""
    rows = spark.read.csv(path, sep="\t", schema="word string, syllables int")
    return rows.groupBy("word").agg(F.min("syllables").alias("syllables"))


def derive_syllables(spark: SparkSession, path: str) -> DataFrame:
    """(word, syllables) from a pronouncing dictionary: phones that end in a stress mark, first pronunciation only."""
    line = F.trim(F.substring_index("value", "#", 1))
    rows = spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith(";;;"))
    parts = F.split("line", r"\s+")
    words = rows.select(F.lower(parts[0]).alias("word"), F.size(F.filter(parts, lambda p: p.rlike("^[A-Z]+[012]$"))).alias("syllables"))
    return words.filter(~F.col("word").rlike(r"\(\d+\)$"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """Distributed JSON lines; Spark's committer makes them appear whole, old output goes first."""
    df.write.mode("overwrite").json(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, ASCII: equal values have equal text, so that its digest identifies them."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def write_json(value: object, path: str) -> None:
    """One artifact, replaced in one step: sorted keys, two blanks of indent, ASCII, a line feed at the end."""
    _replace(path, json.dumps(value, sort_keys=True, indent=2) + "\n")


def write_text(text: str, path: str) -> None:
    """A text with exactly one line feed at its end, replaced in one step."""
    _replace(path, text.rstrip("\n") + "\n")


def _replace(path: str, content: str) -> None:
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def remove_stale(path: str) -> None:
    """No earlier success may be left when a run fails."""
    Path(path).unlink(missing_ok=True)


def guard_output(output: str, inputs: list[str], stores: list[str]) -> None:
    """An output may be neither an input nor inside a store of policies, by its written or its resolved path."""
    forms = {os.path.normcase(os.path.abspath(output)), os.path.normcase(os.path.realpath(output))}
    for path in inputs:
        if forms & {os.path.normcase(os.path.abspath(path)), os.path.normcase(os.path.realpath(path))}:
            raise ValueError(f"output {output} is also an input")
    for store in stores:
        for root in (os.path.normcase(os.path.abspath(store)), os.path.normcase(os.path.realpath(store))):
            if any(f == root or f.startswith(root + os.sep) for f in forms):
                raise ValueError(f"output {output} lies in the store {store}")
