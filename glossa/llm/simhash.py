"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of eight segments. If two fingerprints differ in at most t
bits, some segment starts a chain in which the first l segments together differ in at most l * t / 8
bits, for every l. For chains of ``CHAIN`` segments the budgets allow few patterns of unequal segments;
each leaves a set of equal segments, and these sets, for each start, are the keys of an equi-join. Rows
that share a key are candidates; the whole chain's budgets prune them before the full Hamming check.

Texts give one fingerprint each; equal ones collapse to one row before the join. Rows of a key come
together sorted; a run of them is linked inside one task and gives a spanning star of each component,
never all its pairs. Stars over all keys join to components in distributed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lean, materialize, numbered, renamed_back, slices, text_bytes
from glossa.llm.components import components

SEGMENTS, CHAIN = 8, 5
SMALL_RUN = 48  # longer runs take the path for large groups
SEED = 42


def simhash(text: bytes, n_words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case; 0 if it has no word."""
    words = text.lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n_words + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n_words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", n_words: int = 4) -> DataFrame:
    """The ``carry`` columns and ``fp`` (the 64 bits as a signed long) of every row; null texts are empty."""
    narrow = docs.select(*carry, F.col(text_col).alias("_text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(x, n_words) for x in text_bytes(batch.column(len(carry)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*carry, "fp"])

    schema = narrow.drop("_text").schema.add("fp", "long")
    return narrow.mapInArrow(run, schema)


def budgets(max_bits: int) -> list[int]:
    """Bits that the first 1, 2, ... segments of a chain may differ in."""
    return [n * max_bits // SEGMENTS for n in range(1, SEGMENTS + 1)]


def key_sets(max_bits: int, chain: int = CHAIN) -> list[tuple[int, ...]]:
    """Sets of equal segments, as distances from a chain's start, one of which every viable chain has.

    A chain whose prefix of l segments differs in at most ``budgets[l - 1]`` bits has at most so many
    unequal segments there. Each such pattern keeps its first ``chain - budgets[chain - 1]`` equal ones.
    """
    most = budgets(max_bits)[:chain]
    sets = set()
    for unequal in product((0, 1), repeat=chain):
        if all(sum(unequal[: n + 1]) <= most[n] for n in range(chain)):
            sets.add(tuple(k for k in range(chain) if not unequal[k])[: chain - most[-1]])
    return sorted(sets)


def _keys(fp: Column, max_bits: int) -> Column:
    """All keys of a fingerprint: number of (start, set) above the bits of the set's segments."""
    sets = key_sets(max_bits)
    segment = [F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)) for k in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        for n, members in enumerate(sets):
            key = F.lit(start * len(sets) + n).cast("long")
            for k in members:
                key = F.shiftleft(key, 8).bitwiseOR(segment[(start + k) % SEGMENTS])
            keys.append(key)
    return F.array(*keys)


def _links(x: np.ndarray, y: np.ndarray, start: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs pass the chain's budgets from their key's start, and then the full check."""
    differ = x ^ y
    alive = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for n, most in enumerate(budgets(max_bits)):
        at = ((start[alive] + n) % SEGMENTS).astype(np.uint64) * np.uint64(8)
        total = total + np.bitwise_count((differ[alive] >> at) & np.uint64(255))
        fine = total <= most
        alive, total = alive[fine], total[fine]
    good = np.zeros(len(x), bool)
    good[alive] = np.bitwise_count(differ[alive]) <= max_bits
    return good


def _roots(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least member of each one's component."""
    labels = np.arange(n) if labels is None else labels
    while len(i):
        least = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, labels[i], least)
        np.minimum.at(new, labels[j], least)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == labels).all():
            break
        labels = new
    return labels


def _chain_masks(start: int, max_bits: int) -> list[tuple[np.uint64, int]]:
    """(bits of the first l segments from ``start``, their budget) for the l past a key's own part, the whole ring last."""
    out, mask = [], 0
    for n, most in enumerate(budgets(max_bits)):
        mask |= 255 << 8 * ((start + n) % SEGMENTS)
        if n >= CHAIN - 1:
            out.append((np.uint64(mask), most))
    return out


def _large_run(fps: np.ndarray, max_bits: int, start: int) -> np.ndarray:
    """Roots of the links among many distinct fingerprints of one key.

    Neighbours at one bit are found by lookup; in a dense group they leave one main component. Only
    what stands outside it is compared with everything, in blocks; there each longer chain from the key's
    start prunes by its budget, and what is left meets the full check, which is the whole ring's budget.
    """
    chains = _chain_masks(start, max_bits)
    n = len(fps)
    order = np.argsort(fps)
    there = fps[order]
    labels = np.arange(n)
    for bit in range(64):
        other = fps ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(there, other), n - 1)
        hit = np.flatnonzero(there[at] == other)
        labels = _roots(n, hit, order[at[hit]], labels)
    main = np.bincount(labels).argmax()
    outside = np.flatnonzero(labels != main)
    for k in range(0, len(outside), 256):
        some = outside[k : k + 256]
        for m in range(0, n, 65536):
            mask, most = chains[0]
            i, j = np.nonzero(np.bitwise_count((fps[some][:, None] ^ fps[None, m : m + 65536]) & mask) <= most)
            for mask, most in chains[1:]:
                near = np.bitwise_count((fps[some[i]] ^ fps[m + j]) & mask) <= most
                i, j = i[near], j[near]
            labels = _roots(n, some[i], m + j, labels)
    return labels


def _stars(keys: np.ndarray, fps: np.ndarray, max_bits: int, n_sets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from members to the root of their component, for whole runs of equal keys."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    begin = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((begin, [len(keys)])))
    a, b = [], []
    for s, n in zip(begin[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist(), strict=True):
        run = fps[s : s + n]
        roots = _large_run(run, max_bits, int(keys[s] >> width) // n_sets)
        out = roots != np.arange(n)
        a.append(run[out])
        b.append(run[roots[out]])
    some = np.repeat((size > 1) & (size <= SMALL_RUN), size)
    k, f = keys[some], fps[some]
    start = (k >> width) // n_sets
    left, right = [], []
    for shift in range(1, SMALL_RUN):
        i = np.flatnonzero(k[:-shift] == k[shift:])
        if not len(i):
            break
        i = i[_links(f[i], f[i + shift], start[i], max_bits)]
        left.append(i)
        right.append(i + shift)
    if left:
        roots = _roots(len(f), np.concatenate(left), np.concatenate(right))
        out = roots != np.arange(len(f))
        a.append(f[out])
        b.append(f[roots[out]])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def stars(distinct_fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints within ``max_bits``, enough to connect every component."""
    n_sets = len(key_sets(max_bits))
    width = 8 * len(key_sets(max_bits)[0])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _stars(keys, fps, max_bits, n_sets, width)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or keys[0] != held[0][0][0]):
                yield out(np.concatenate([x for x, _ in held] + [keys[:cut]]), np.concatenate([x for _, x in held] + [fps[:cut]]))
                held = []
            elif cut:
                yield out(keys[:cut], fps[:cut])
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield out(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    keyed = distinct_fps.select(F.explode(_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def fingerprint_components(fps: DataFrame, best: str, max_bits: int = 4) -> DataFrame:
    """(fp, component): the least ``best`` of all rows whose fingerprints are connected, for each fp.

    ``fps`` has (fp, ``best``); it should be a written table.
    """
    groups = materialize(fps.groupBy("fp").agg(F.min(best).alias("first")), "fps")
    labels = components(stars(groups.select("fp"), max_bits))
    named = groups.join(labels.withColumnRenamed("node", "fp"), "fp")
    of_label = named.groupBy("label").agg(F.min("first").alias("least"))
    linked = materialize(labels.join(of_label, "label").select(F.col("node").alias("fp"), "least"), "linked")
    return groups.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"))


def near_duplicates(docs: DataFrame, n_words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id among all that can be reached over links of at most ``max_bits``
    differing bits. Texts without a word (null ones too) have fingerprint zero and link like others.
    A null doc_id keeps its row and never names a component unless all its members are null. Repeated
    rows are each returned; an empty table gives no rows; other columns are not read.
    """
    fps = materialize(fingerprints(docs, ["doc_id"], n_words=n_words), "fingerprints")
    named = fingerprint_components(fps, "doc_id", max_bits)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def row_key(docs: DataFrame) -> Column:
    """MD5 over all columns of a row (in their JSON form, nulls apart from empty texts)."""
    return F.md5(F.encode(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), "UTF-8"))


def keep_first(docs: DataFrame, n_words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, the one of the least doc_id (nulls last, then by row).

    Columns are those of ``docs``; of wholly equal rows one stays.
    """
    rows, names = numbered(docs)
    keyed = rows.withColumn("_row_key", row_key(rows))
    doc_id = F.col(names["doc_id"])
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row_key").alias("row"))
    fps = materialize(fingerprints(keyed.withColumn("_rank", rank), ["_rank"], names["text"], n_words), "fingerprints")
    keep = materialize(fingerprint_components(fps, "_rank", max_bits).select(F.col("component.row").alias("_row_key")).distinct(), "kept")
    return renamed_back(keyed.join(keep, "_row_key", "left_semi").dropDuplicates(["_row_key"]), names)
