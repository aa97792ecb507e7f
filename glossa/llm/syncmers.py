"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers (by hash, the leftmost of equal
ones) is its first or its last. That depends on the k-mer alone, so texts that share a passage share
its anchors, wherever it stands, and any k - s + 1 neighbouring k-mers have an anchor. A fingerprint is
the sequence of a text's anchors, each with the step from the one before and a 16-bit hash, in base64.

Likeness matches anchors by position: first those of equal hash and equal place, then the others
whose shift between the texts is shared by at least three. It is the matched share of the larger
fingerprint.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S = 12, 4  # K is a multiple of S; K - S is a power of two
LEAST_SHIFTED = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Anchors = tuple[np.ndarray, np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def anchors(points: np.ndarray) -> Anchors:
    """(positions, 16-bit hashes) of the closed syncmers; a text shorter than ``K`` is one anchor."""
    n = len(points)
    if n < K:
        h = np.uint64(n)
        for p in points.tolist():
            h = _mixed(np.array([h]) * _B + np.uint64(p))[0]
        return np.zeros(min(n, 1), np.int64), np.full(min(n, 1), h >> np.uint64(48), np.uint64).astype(np.uint16)
    c = points.astype(np.uint64)
    h = c[: n - S + 1]
    for j in range(1, S):
        h = h * _B + c[j : n - S + 1 + j]
    h = _mixed(h)
    low, span = h, 1  # least of the next ``span`` s-mers
    while span < K - S:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - K + 1
    first, last = h[:m], h[K - S : K - S + m]
    at = np.flatnonzero((first <= low[1 : m + 1]) | (last < low[:m]))
    whole = h[at]
    for j in range(S, K - S + 1, S):
        whole = whole * _B + h[at + j]
    return at, (_mixed(whole) >> np.uint64(48)).astype(np.uint16)


def edited_anchors(of_text: Anchors, kept: int, n: int, edited: np.ndarray) -> Anchors:
    """Anchors of a text whose first ``kept`` of ``n`` code points stay: only k-mers past them are new."""
    if min(kept, n, len(edited)) < K:
        return anchors(edited)
    stay = of_text[0] <= kept - K
    rest = edited[kept - K + 1 :]
    if len(rest) < K:
        return of_text[0][stay], of_text[1][stay]
    at, h = anchors(rest)
    return np.concatenate([of_text[0][stay], at + kept - K + 1]), np.concatenate([of_text[1][stay], h])


def encode(found: Anchors) -> str:
    """Three bytes an anchor: step (at most 255, which closed syncmers never reach), hash."""
    at, h = found
    out = np.empty((len(at), 3), np.uint8)
    out[:, 0] = np.minimum(np.diff(at, prepend=0), 255)
    out[:, 1:] = h.astype("<u2").view(np.uint8).reshape(-1, 2)
    return base64.b64encode(out.tobytes()).decode()


def decode(fingerprint: str) -> Anchors:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 3)
    return np.cumsum(raw[:, 0], dtype=np.int64), raw[:, 1:].copy().view("<u2").ravel()


def likeness(a: Anchors, b: Anchors) -> float:
    """Matched share of the larger of two fingerprints, 0 to 1; two empty ones are alike."""
    most = max(len(a[0]), len(b[0]))
    if not most:
        return 1.0
    if not min(len(a[0]), len(b[0])):
        return 0.0
    x, y = a[0] << 16 | a[1], b[0] << 16 | b[1]  # rising, as positions do
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    matched = int(same.sum())
    if matched < most:
        others = np.ones(len(y), bool)
        others[at[same]] = False
        p, h, q, g = a[0][~same], a[1][~same], b[0][others], b[1][others]
        if len(p) and len(q):
            order = np.argsort(g, kind="stable")
            q, g = q[order], g[order]
            k = np.minimum(np.searchsorted(g, h), len(g) - 1)
            hit = g[k] == h
            shift = np.sort(q[k[hit]] - p[hit])
            if len(shift):
                first = np.flatnonzero(np.concatenate(([True], shift[1:] != shift[:-1])))
                runs = np.diff(np.concatenate((first, [len(shift)])))
                matched += int(runs[runs >= LEAST_SHIFTED].sum())
    return min(1.0, matched / most)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below a value, by binary search; nulls come first."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(x).cast("long") for x in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(table, middle) <= value
        return F.when(a["lo"] >= a["hi"], a).when(below, F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, step, lambda a: a["lo"]))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, halo, doc_id, text), each bucket in order and followed by the next bucket's first rows.

    Ranges of doc_id are cut at quantiles that are ids of the table, so that a bound is its range's first
    id. Rows with that id also go, as halo, to the range before; the very first ones to the last.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, least, nulls = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts), F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    bounds = sorted({x for x in cuts or [] if x > least or nulls})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == least
    is_bound = F.get(F.array(*[F.lit(x).cast("long") for x in bounds]), F.col("bucket") - 1) == F.col("doc_id") if bounds else F.lit(False)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    before = F.when(is_first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("halo"))).when(is_bound, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("halo")))
    placed = rows.withColumn("_to", F.explode(F.array_compact(F.array(own, before)))).select("_to.bucket", "_to.halo", "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the next row in (doc_id, text), nulls first; after the last one comes the first.
    Repeated rows follow each other. A null text is empty: its fingerprint is empty and like that of other
    empty texts alone. An empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, points, anchors) of a row that waits for its next
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for bucket, halo, doc_id, text in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if halo and (held is None or held[0] != bucket):
                        continue  # the first halo row was enough
                    points = code_points(text)
                    found = anchors(points)
                    if held is not None and held[0] == bucket:
                        _, own_id, own, own_points, own_found = held
                        n = len(own_points)
                        kept = n - n // 4
                        edited = own[:kept] + text[: n // 4]
                        new = edited_anchors(own_found, kept, n, np.concatenate([own_points[:kept], points[: n // 4]]))
                        sha = hashlib.sha256(edited.encode()).hexdigest()
                        out.append((own_id, n, sha, encode(own_found), encode(new), likeness(own_found, new), likeness(own_found, found)))
                    held = None if halo else (bucket, doc_id, text, points, found)
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
