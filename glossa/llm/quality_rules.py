"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured over its whole text. Documents that pass the base rules feed one sketch for
each (language, source, measure): counts of log-linear buckets, whose lower edge keeps a value's six
leading bits (a relative error under 1/32). Adding counts merges two sketches, so partial sketches of
any partitions, and of sources to a language, are the same as one sketch over all rows, whatever the
order. Fences are read from quantiles: the median plus or minus a multiple of the spread, which is the
distance from the lower quartile, or, where that is less, what one event weighs in a text of the group's
median length (a symbol, a line, a repeated window) and for word lengths the sketch's own resolution.
So each fence follows its group's texts; none is a fixed cutoff. A group's quantiles are averaged with its
language's, which weigh as much as ``PRIOR`` documents: small groups lean on their language without a
switch. Fences are joined back to filter documents. All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import materialize, numbered, renamed_back, text_bytes

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space, and the later bytes of a code point
_SYMBOLS = b"#*$%&|<>"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Measure -> (numerator, denominator), in thousandths.
MEASURES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Measure -> (multiple of the spread, least events, the length they are set against); word_length has the resolution.
FENCES = {"symbols": (8, 1, "words"), "dup_lines": (8, 1, "lines"), "repeats": (16, 6, "words"), "word_length": (8, None, None)}
LENGTHS = {"words": "n_words", "lines": "n_lines"}
QUANTILES = (25, 50)
RESOLUTION, PRIOR = 32, 100


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    m = len(seen)
    key = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:  # else the product of three numbers fits
        key = np.unique(key, return_inverse=True)[1]
    key = key * m + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def measures_of(text: bytes) -> tuple[int, ...]:
    """The ``FIELDS`` of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def measure(docs: DataFrame, text_col: str = "text", into: str = "_measures") -> DataFrame:
    """``docs`` with a struct column of ``FIELDS`` (long) over the whole text; null texts have no words.

    Only the text goes to Python. The function is marked so that no plan evaluates it twice for a row.
    """
    kind = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])

    @F.arrow_udf(kind)
    def measured(text: pa.Array) -> pa.Array:
        got = np.array([measures_of(x) for x in text_bytes(text)], np.int64).reshape(-1, len(FIELDS))
        return pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(FIELDS))], FIELDS)

    return docs.withColumn(into, measured.asNondeterministic()(F.col(text_col)))


def base_failed(m: str = "_measures") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _value(name: str, m: str) -> Column:
    over, under = MEASURES[name]
    return F.expr(f"CASE WHEN {m}.{under} > 0 THEN ({m}.{over} * 1000) div {m}.{under} ELSE 0L END")


def _bucket(value: str) -> Column:
    return F.expr(f"shiftleft(shiftright({value}, greatest(0, length(bin({value})) - 6)), greatest(0, length(bin({value})) - 6))")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source", m: str = "_measures") -> DataFrame:
    """(lang, source, measure, bucket, n): partial counts are merged before and after the shuffle."""
    values = {k: _value(k, m) for k in MEASURES} | {k: F.col(f"{m}.{f}") for k, f in LENGTHS.items()}
    rows = measured.filter(~base_failed(m)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])).alias("x"))
    return rows.select("lang", "source", "x.*").withColumn("bucket", _bucket("value")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame) -> DataFrame:
    """The sketches of languages: those of their sources added up."""
    return sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """(group, measure, total, q25, q50) of each group of a sketch: the least bucket that reaches the rank."""
    keys = [c for c in sketch.columns if c not in ("bucket", "n")]
    group = Window.partitionBy(*keys)
    run = sketch.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys).agg(F.max("total").alias("total"), *[F.min(F.when(F.expr(f"upto >= greatest(1, ({q} * total + 99) div 100)"), F.col("bucket"))).alias(f"q{q}") for q in QUANTILES])


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, group_docs, an upper fence for each measure, a lower one for word_length, set_by_spread).

    ``set_by_spread`` counts the measures whose spread, rather than the weight of one event, set the fence.
    """
    own, whole = quantiles(sketch), quantiles(merge(sketch)).select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), *[F.col(f"q{q}").alias(f"_q{q}") for q in QUANTILES])
    rows = own.join(whole, own["lang"].eqNullSafe(whole["_lang"]) & (F.col("measure") == F.col("_measure")))
    mixed = F.struct(*[F.expr(f"(total * q{q} + {prior} * _q{q}) div (total + {prior})").alias(f"q{q}") for q in QUANTILES])
    one = lambda name: F.max(F.when(F.col("measure") == name, mixed)).alias(name)
    wide = rows.groupBy("lang", "source").agg(F.max("total").alias("group_docs"), *[one(name) for name in [*MEASURES, *LENGTHS]])
    fences, by_spread = [], F.lit(0)
    for name, (times, events, length) in FENCES.items():
        unit = F.expr(f"{name}.q50 div {RESOLUTION}") if events is None else F.expr(f"{1000 * events} div greatest(1, {length}.q50)")
        spread = F.col(f"{name}.q50") - F.col(f"{name}.q25")
        reach = times * F.greatest(spread, unit, F.lit(1).cast("long"))
        by_spread = by_spread + F.when(spread > unit, 1).otherwise(0)
        fences.append((F.col(f"{name}.q50") + reach).alias(f"{name}_high"))
        if events is None:
            fences.append((F.col(f"{name}.q50") - reach).alias(f"{name}_low"))
    return wide.select("lang", "source", "group_docs", *fences, by_spread.alias("set_by_spread"))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", m: str = "_measures") -> DataFrame:
    """Add ``_failed``, ``_kept`` and ``_group_docs`` by the limits of the row's group.

    The limits are joined by an equi-join; the planner broadcasts them only if the written table is small.
    """
    right = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct("*").alias("_t"))
    joined = measured.join(right, F.col(lang).eqNullSafe(F.col("_l")) & F.col(source).eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for name in MEASURES:
        inside = inside & (_value(name, m) <= F.col(f"_t.{name}_high"))
    inside = inside & (_value("word_length", m) >= F.col("_t.word_length_low"))
    failed = base_failed(m)
    return joined.withColumn("_failed", failed).withColumn("_kept", ~failed & F.coalesce(inside, F.lit(True))).withColumn("_group_docs", F.coalesce("_t.group_docs", F.lit(0)).cast("long")).drop("_l", "_s", "_t")


def quality_verdicts(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(doc_id, ``FIELDS``, base_failed, kept, group_docs) for every row of ``docs``.

    A null lang or source is a group of its own. A null or empty text has no words and fails the base
    rules. Repeated rows are judged each. An empty table gives no rows. Other columns are not read.
    """
    measured = materialize(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measures")
    limits = materialize(thresholds(materialize(sketches(measured), "sketch"), prior), "limits")
    judged = judge(measured, limits)
    return judged.select("doc_id", "_measures.*", F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_group_docs").alias("group_docs"))


def keep_good(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns, whatever their names.

    The texts are measured once for the sketches and once for the verdict, rather than shuffled. A null lang
    or source is a group of its own; null and empty texts go; repeated rows stay; an empty table gives no rows.
    """
    narrow = docs.select("text", "lang", "source")
    limits = materialize(thresholds(materialize(sketches(measure(narrow)), "sketch"), prior), "limits")
    rows, names = numbered(docs)
    judged = judge(measure(rows, names["text"]), limits, names["lang"], names["source"])
    return renamed_back(judged.filter("_kept"), names)
