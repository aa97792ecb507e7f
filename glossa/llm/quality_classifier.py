"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each text gives fixed statistics of itself alone. Features ``sqrt(2/D) cos(W x + b)`` with Gaussian W
approximate a Gaussian kernel over the standardised statistics, so that a ridge fit on them is an
approximate kernel ridge fit. Every task sums its labelled rows' moments and normal equations; the
sums meet by entry, and the driver solves one system of D + 1 unknowns. Raw scores of the labelled
rows, counted in a fixed number of bins, are pooled to a monotone curve that turns them to
probabilities. All labelled rows allowed for learning are used; what reaches the driver has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import id_residue, lean, materialize, numbered, renamed_back, text_bytes

STATISTICS = [
    "log_chars", "log_words", "mean_word", "spread_word", "short_words", "long_words", "distinct_words", "log_lines", "dup_lines", "upper", "digits", "white", "symbols", "stops",
    "calls", "brackets", "joiners", "other_bytes", "entropy", "compressed", "symbols_a_word", "calls_a_word",
]
#: Byte classes, in the order of the columns of ``_CLASSES``.
_SETS = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".,;:", b"!?", b"()[]{}\"'", b"@/_-+=~^\\`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_CLASSES = np.stack([np.isin(np.arange(256), list(s)) for s in _SETS], 1).astype(np.float64)
BINS = 2000
LOW, HIGH = -0.5, 1.5


def statistics_of(text: bytes) -> list[float]:
    """The ``STATISTICS`` of one UTF-8 text; zeros if it is empty."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, white, symbols, stops, calls, brackets, joiners, later, lead = (counts @ _CLASSES).tolist()
    chars = len(text) - later
    words = text.split()
    n = max(len(words), 1)
    sizes = np.array([len(w) for w in words] or [0], np.float64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = counts[counts > 0] / len(text)
    return [
        np.log1p(chars), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes <= 3).mean(), (sizes >= 12).mean(), len(set(words)) / n, np.log1p(len(lines)),
        (len(lines) - len(set(lines))) / max(len(lines), 1), upper / max(upper + lower, 1), digits / chars, white / chars, symbols / chars, stops / chars,
        calls / chars, brackets / chars, joiners / chars, lead / chars, float(-(p * np.log2(p)).sum()), len(zlib.compress(text, 1)) / len(text), np.log1p(symbols / n), np.log1p(calls / n),
    ]


def statistics(docs: DataFrame, text_col: str = "text", into: str = "_statistics") -> DataFrame:
    """``docs`` with an array<double> of the ``STATISTICS`` of the whole text; null texts are empty.

    Only the text goes to Python. The function is marked so that no plan evaluates it twice for a row.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(text: pa.Array) -> pa.Array:
        return _lists(np.array([statistics_of(x) for x in text_bytes(text)], np.float64).reshape(-1, len(STATISTICS)))

    return docs.withColumn(into, measured.asNondeterministic()(F.col(text_col)))


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


@dataclass
class QualityModel:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all rows of ``of(statistics, labels)``, a vector of ``size``: by task first, then by entry."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["entry", "part"])

    parts = rows.select("_statistics", "label").mapInArrow(run, "entry int, part double")
    out = np.zeros(size)
    for entry, value in parts.groupBy("entry").agg(F.sum("part").alias("part")).collect():  # at most ``size`` rows
        out[entry] = value
    return out


def fit(rows: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 7) -> QualityModel:
    """A model from (``_statistics``, ``label`` double); rows must be a written table.

    Without rows every score is 0.5.
    """
    k = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * k + 1)
    n = moments[0]
    rng = np.random.default_rng(seed)
    mean = moments[1 : k + 1] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[k + 1 :] / max(n, 1) - mean**2, 0))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(k, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.array([0.0]), np.array([0.5]))
    if not n:
        return model
    upper = np.triu_indices(n_features + 1)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = _summed(rows, equations, len(upper[0]) + n_features + 1)
    gram = np.zeros((n_features + 1, n_features + 1))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    model.weights = np.linalg.solve(gram + ridge * n * np.eye(n_features + 1), sums[len(upper[0]) :])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    counts = _summed(rows, binned, 2 * BINS)
    model.knots, model.values = isotonic(counts[:BINS], counts[BINS:])
    return model


def isotonic(n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; a knot in the middle of each pool."""
    pools: list[list[float]] = []  # rows, hits, first bin, last bin
    for at in np.flatnonzero(n):
        pools.append([n[at], hits[at], at, at])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    middle = np.array([(p[2] + p[3] + 1) / 2 for p in pools])
    return LOW + middle * (HIGH - LOW) / BINS, np.array([p[1] / p[0] for p in pools])


def labelled(measured: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """(``_statistics``, ``label``) of the rows that may be learned from; several labels of an id count as their mean."""
    allowed = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(id_residue(F.col("doc_id"), modulus) != held_out)
    y = allowed.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    return materialize(measured.select("doc_id", "_statistics").join(y, "doc_id").select("_statistics", "label"), "labelled")


def scored(measured: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """Replace ``_statistics`` by the score, double."""
    names = [c for c in measured.columns if c != "_statistics"]
    at = measured.columns.index("_statistics")
    keep = [i for i in range(len(measured.columns)) if i != at]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch.column(at))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(got)], [*names, into])

    return measured.mapInArrow(run, T.StructType([*[f for f in measured.schema.fields if f.name != "_statistics"], T.StructField(into, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1; a null id counts as empty
    text there and is never labelled. Null and empty texts get the score of zero statistics. Repeated
    rows get equal scores; an empty table gives no rows; other columns are not read.
    """
    measured = materialize(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    out = scored(measured, fit(labelled(measured, labels)))
    return out.select("doc_id", (id_residue(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with its columns.

    Statistics are computed once for the fit and once for the scores, rather than shuffling texts.
    """
    measured = materialize(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = fit(labelled(measured, labels))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics_of(x) for x in text_bytes(text)], np.float64).reshape(-1, len(STATISTICS))))

    rows, names = numbered(docs)
    scored_rows = rows.withColumn("_score", score.asNondeterministic()(F.col(names["text"])))
    return renamed_back(scored_rows.filter(F.col("_score") >= least), names)
