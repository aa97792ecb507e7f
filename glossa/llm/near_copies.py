"""Near copies by exact five-word similarity: banded candidates, a wide SimHash filter, verified sets.

A text is its set of five-word shingles (A-Z in lower case; a shorter text is one shingle). Sets with
equal members collapse to one, and each has a 256-bit SimHash. Keys of candidates are bits of the SimHash:
``TABLES`` tables take ``KEY_BITS`` fixed places of it each, and texts that are equal there meet. A pair that
differs in d of the 256 bits (about 39 at a similarity of 0.8, 128 for unrelated texts) shares a table with
probability 1 - (1 - (1 - d / 256)^KEY_BITS)^TABLES, 0.999 at 39 bits. An exact pigeonring join of all pairs
so far apart would need more keys than there are pairs. Pairs that differ in more than ``MAX_BITS`` are
dropped by the pigeonring filter of the SimHash operator, chains of segments within proportional budgets
before the full count; all others are compared by their whole sets.

In a large group most texts may be near in SimHash and yet apart in similarity, so that pairs grow with the square
of the group. Two bounds that lose no link keep these from the comparison: the sizes of the sets, and for
texts that met ``CROWD`` others, a bitmap with the parity of the shingles of each place. Two bitmaps differ in
no more places than the sets have shingles apart, and a similarity allows a share of these alone. A pair that
was compared once is not compared again.

The first tables link most of a large group; the others, and the pass over long runs, look only at pairs
whose components are still apart, as no other pair can change a group. Runs of a key up to ``SMALL_RUN`` give
all such pairs. Longer ones first give pairs with their least member and with neighbours; what these leave
apart is then compared across components, so no pair is skipped that could still join two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lean, materialize, numbered, renamed_back, slices, text_bytes
from glossa.llm.components import contracted
from glossa.llm.simhash import SEED, row_key

N_WORDS = 5
TABLES, FIRST_TABLES, KEY_BITS = 96, 8, 16
WORDS_OF_64, MAX_BITS, CHAIN = 4, 80, 4
SMALL_RUN = 16
CROWD = 4
_random = np.random.default_rng(SEED)
_OF_WORD = _random.integers(0, 2**64, WORDS_OF_64, np.uint64) | np.uint64(1)
#: The bits of each table's key: every 16 tables use each bit once.
_PLACES = np.concatenate([_random.permutation(64 * WORDS_OF_64) for _ in range(TABLES * KEY_BITS // (64 * WORDS_OF_64))]).reshape(TABLES, KEY_BITS)
_SKETCH = [f"s{k}" for k in range(WORDS_OF_64)]


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; never empty."""
    words = text.lower().split()  # of bytes: ASCII only
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= N_WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - N_WORDS + 1]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[N_WORDS - 1 :].tolist(), strict=True)], np.uint64))


def wide_simhash(h: np.ndarray) -> np.ndarray:
    """The words of the SimHash of a shingle set."""
    ones = np.zeros((WORDS_OF_64, 64), np.int64)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024]
        mixed = part[:, None] * _OF_WORD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _OF_WORD[::-1]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64).reshape(ones.shape)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view(np.uint64)[:, 0]


def table_keys(words: np.ndarray, first: int, last: int) -> np.ndarray:
    """Keys of SimHashes (rows of words) in the tables from ``first`` to before ``last``: the table's number above its bits."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    taken = np.packbits(bits[:, _PLACES[first:last].ravel()], axis=1, bitorder="little")
    own = np.ascontiguousarray(taken).view(np.uint16).astype(np.int64)
    return own + (np.arange(first, last) << KEY_BITS)


def parity_bitmap(h: np.ndarray) -> bytes:
    """For each place, whether an odd number of shingles have their lowest bits there; places are a power of two, at least 4 a shingle.

    A bitmap of half the places is the exclusive or of the halves. Up to 16,384 places, as longer texts are few.
    """
    places = 1 << min(14, max(8, (4 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _sketched(rows: DataFrame) -> DataFrame:
    """(_rank, fp, s0 to s3, n) from (_rank, text); ``fp`` names the shingle set, ``n`` is its size."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x) for x in text_bytes(batch.column(1))]
            if not sets:
                continue
            fps = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            words = np.array([wide_simhash(h) for h in sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS_OF_64)], pa.array([len(h) for h in sets], pa.int64())], ["_rank", "fp", *_SKETCH, "n"])

    schema = rows.select("_rank").schema.add("fp", "long")
    for name in (*_SKETCH, "n"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def _key_bits(keys: DataFrame) -> bytes:
    """A bit for each key of all tables, set if it is in ``keys``: 768 KB, whatever the input."""

    def of_table(group: pa.Table) -> pa.Table:
        own = np.zeros(1 << KEY_BITS, np.uint8)
        keys = group.column(0).to_numpy()
        own[keys & ((1 << KEY_BITS) - 1)] = 1
        return pa.table({"place": pa.array([int(keys[0]) >> KEY_BITS]), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    out = bytearray(TABLES << KEY_BITS >> 3)
    width = 1 << KEY_BITS >> 3
    for row in keys.select("key").distinct().groupBy(F.shiftright("key", KEY_BITS)).applyInArrow(of_table, "place long, bits binary").collect():
        out[row.place * width : (row.place + 1) * width] = row.bits
    return bytes(out)


def _keyed(one: DataFrame, first: int, last: int, only: bytes | None = None) -> DataFrame:
    """(key, fp, s0 to s3, n, label, bits): a row for each table of each (fp, s0 to s3, n, label, bits), of the keys that ``only`` has."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = None if only is None else np.unpackbits(np.frombuffer(only, np.uint8), bitorder="little").view(bool)
        for batch in slices(batches):
            if batch.num_rows:
                words = np.column_stack([c.to_numpy() for c in batch.columns[1 : 1 + WORDS_OF_64]])
                keys = table_keys(words, first, last)
                at, place = np.nonzero(np.ones(keys.shape, bool) if there is None else there[keys])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, place]), *batch.take(pa.array(at)).columns], ["key", *batch.schema.names])

    schema = one.select(F.lit(0).cast("long").alias("key"), *one.columns).schema
    return one.mapInArrow(run, schema)


def _close(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs within ``MAX_BITS``: of the ring of 16-bit segments some chain stays in its budgets, then all bits are counted.

    If all segments together differ in at most ``MAX_BITS``, some start has, for every l, its first l segments within l / 16 of that.
    """
    differ = np.bitwise_count((words[i] ^ words[j]).view(np.uint16))
    ring = differ.shape[1]
    near, total = np.ones(differ.shape, bool), np.zeros(differ.shape, np.uint8)
    for n in range(CHAIN):
        total += np.roll(differ, -n, axis=1)
        near &= total <= (n + 1) * MAX_BITS // ring
    out = near.any(1)
    out[out] = differ[out].sum(1, dtype=np.int64) <= MAX_BITS
    return out


def _within(bits: np.ndarray, wide: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, tenths: int) -> np.ndarray:
    """Pairs that may have a similarity of ``tenths`` / 10 by their bitmaps (``wide``: bytes of each, 0: none).

    Sets of such a similarity have at most (10 - tenths) / (10 + tenths) of their sizes' sum apart.
    """
    out = np.ones(len(i), bool)
    least = np.minimum(wide[i], wide[j])
    for w in np.unique(least[least > 0]).tolist():
        at = np.flatnonzero(least == w)
        used, where = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        folded = np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, w // 8)) for x in bits[used]])
        x, y = where[: len(at)], where[len(at) :]
        step = (8 << 20) // w
        for k in range(0, len(at), step):
            some = at[k : k + step]
            apart = np.bitwise_count(folded[x[k : k + step]] ^ folded[y[k : k + step]]).sum(1, dtype=np.int64)
            out[some] = (10 + tenths) * apart <= (10 - tenths) * (size[i[some]] + size[j[some]])
    return out


def _near_pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of whole runs (key, fp, s0 to s3, ...) to look at first: all of small runs; in long ones each with the least and with its neighbours.

    Which pairs of a long run these are depends on the texts alone, so that a group that meets in many tables
    gives mostly the same pairs in each, and these collapse.
    """
    edge = np.concatenate(([0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]))
    size = np.diff(edge)
    left = np.repeat(np.where(size <= SMALL_RUN, edge[1:], 0), size) - np.arange(len(rows))  # rows of a small run from here to its end
    for step in range(1, SMALL_RUN):
        i = np.flatnonzero(left > step)
        if not len(i):
            break
        yield i, i + step
    for a, b in zip(edge[:-1][size > SMALL_RUN].tolist(), edge[1:][size > SMALL_RUN].tolist(), strict=True):
        least = a + int(rows[a:b, 1].argmin())
        yield np.full(b - a, least), np.arange(a, b)
        for first in (0, WORDS_OF_64 // 2):
            order = a + np.lexsort(np.roll(rows[a:b, 2 : 2 + WORDS_OF_64], first, axis=1).T)
            yield order[:-1], order[1:]


def _cross_pairs(words: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a run across components: what is outside the main one with everything."""
    _, label, size = np.unique(labels, return_inverse=True, return_counts=True)
    main = label == size.argmax()
    outside = np.flatnonzero(~main)
    for at in range(0, len(outside), 64):
        some = outside[at : at + 64]
        for m in range(0, len(words), 65536):
            there = np.arange(m, min(m + 65536, len(words)))
            i, j = np.nonzero((label[some][:, None] != label[there][None]) & (main[there][None] | (some[:, None] < there[None])))
            yield some[i], there[j]


def _pairs(keyed: DataFrame, long_runs: bool, tenths: int) -> DataFrame:
    """Distinct (a, b) with a < b of ``keyed`` (key, fp, s0 to s3, n, label, bits), of other labels, that the wide SimHash and the bounds let pass.

    A row whose a and b are one key says that its run is long and gave only some of its pairs; with
    ``long_runs`` all pairs are looked at.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def looked(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if not long_runs:
                yield from _near_pairs(rows)
                return
            edge = np.concatenate(([0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)])).tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                for i, j in _cross_pairs(rows[a:b, 2 : 2 + WORDS_OF_64], rows[a:b, 3 + WORDS_OF_64]):
                    yield a + i, a + j

        def out(rows: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(rows[:, 0], return_counts=True)
            long = keys[counts > SMALL_RUN] if not long_runs else keys[:0]
            a, b, held = [long], [long], len(long)
            fp, words, label = rows[:, 1], np.ascontiguousarray(rows[:, 2 : 2 + WORDS_OF_64]).view(np.uint64), rows[:, 3 + WORDS_OF_64]
            size, wide = np.ascontiguousarray(rows[:, 2 + WORDS_OF_64]), np.ascontiguousarray(rows[:, -1])
            for i, j in looked(rows):
                apart = (label[i] != label[j]) & (10 * np.minimum(size[i], size[j]) >= tenths * np.maximum(size[i], size[j]))
                i, j = i[apart], j[apart]
                near = _close(words, i, j)
                i, j = i[near], j[near]
                near = _within(bits, wide, size, i, j, tenths)
                i, j = fp[i[near]], fp[j[near]]
                a.append(np.minimum(i, j))
                b.append(np.maximum(i, j))
                held += len(i)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                    a, b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            *columns, last = batch.columns
            wide = pc.fill_null(pc.binary_length(last), 0).to_numpy(zero_copy_only=False)
            rows = np.column_stack([c.to_numpy() for c in columns] + [wide.astype(np.int64)])
            bits = np.full(len(rows), None, object)
            if wide.any():
                bits[:] = last.to_pylist()
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut or (held and rows[0, 0] != held[0][0][0, 0]):
                yield from out(*map(np.concatenate, zip(*held, (rows[:cut], bits[:cut]), strict=True)))
                held = []
            held.append((rows[cut:], bits[cut:]))
        if held:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """(fp, members) from (fp, text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingle_set(x).view(np.int64) for x in text_bytes(batch.column(1))]
            if sets:
                ends = np.cumsum([0] + [len(h) for h in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["fp", "members"])

    return rows.mapInArrow(run, "fp long, members array<long>")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(fp, bits) from (fp, members)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            bits = [parity_bitmap(np.array(h, np.int64).view(np.uint64)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["fp", "bits"])

    return sets.mapInArrow(run, "fp long, bits binary")


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs whose sets have a similarity of at least ``tenths`` / 10."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(10 * shared >= tenths * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _ends(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Those that are in ``least`` pairs or more."""
    each = pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))
    return each.groupBy("fp").agg(F.count("*").alias("met")).filter(F.col("met") >= least).select("fp")


def keep_first(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """One row of each group of near copies, the one of the least doc_id (nulls last, then by row).

    Groups are what links of a five-word similarity of at least ``tenths`` / 10 connect. Columns are those
    of ``docs``; of wholly equal rows one stays. Texts without a word (null ones too) are one group.
    """
    rows, names = numbered(docs)
    keyed = rows.withColumn("_row_key", row_key(rows))
    doc_id = F.col(names["doc_id"])
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row_key").alias("row"))
    made = materialize(_sketched(keyed.select(rank.alias("_rank"), F.col(names["text"]).alias("text"))), "sketches")
    first = materialize(made.groupBy("fp").agg(F.min("_rank").alias("first")), "firsts")
    one = materialize(made.select("fp", *_SKETCH, "n").dropDuplicates(["fp"]), "ones")
    text = keyed.select("_row_key", F.col(names["text"]).alias("text"))

    def sets_of(fps: DataFrame) -> DataFrame:
        """Sets of the wanted texts alone: which rows they are is known before any text moves."""
        wanted = first.join(fps, "fp", "left_semi").select("fp", F.col("first.row").alias("_row_key"))
        return materialize(_sets(text.join(wanted.hint("merge"), "_row_key").dropDuplicates(["fp"]).select("fp", "text")), "sets")

    sets = links = labels = long = compared = None
    for tables in ((0, FIRST_TABLES), (FIRST_TABLES, TABLES), None):
        marked = one.withColumn("label", F.col("fp")).withColumn("bits", F.lit(None).cast("binary"))
        if labels is not None:
            bits = materialize(_bitmaps(sets.join(_ends(compared, CROWD), "fp", "left_semi")), "bitmaps")
            marked = one.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")).join(bits, "fp", "left")
        if tables:
            found = materialize(_pairs(_keyed(marked, *tables), False, tenths), "pairs")
            marks = found.filter("a = b").select(F.col("a").alias("key"))
            long = marks if long is None else long.union(marks)
        elif long.limit(1).count():
            found = materialize(_pairs(_keyed(marked, 0, TABLES, _key_bits(long)), True, tenths), "pairs")
        else:
            break
        pairs = found.filter("a < b")
        if compared is not None:
            pairs = materialize(pairs.join(compared, ["a", "b"], "left_anti"), "pairs-new")
        compared = pairs if compared is None else compared.union(pairs)
        ends = _ends(pairs)
        new = materialize(ends if sets is None else ends.join(sets.select("fp"), "fp", "left_anti"), "ends")
        if new.limit(1).count():
            made_now = sets_of(new)
            sets = made_now if sets is None else sets.union(made_now)
        if sets is not None:
            similar = materialize(_similar(pairs, sets, tenths), "links")
            links = similar if links is None else links.union(similar)
            labels = contracted(links)
    if labels is None:
        labels = one.select(F.col("fp").alias("node"), F.col("fp").alias("label")).limit(0)
    grouped = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("label", "fp").alias("label"))
    keep = materialize(grouped.agg(F.min("first").alias("least")).select(F.col("least.row").alias("_row_key")), "kept")
    return renamed_back(keyed.join(keep.hint("merge"), "_row_key", "left_semi").dropDuplicates(["_row_key"]), names)
