"""Best-fit packing of token sequences with swap-based local search.

Documents become ids and an end id; those over the capacity are cut into full pieces. Pieces are dealt
by a hash to groups of a bounded mean size, which pack apart: best fit in falling length, then a local
search that moves a piece, exchanges one for one, two for one or one for two between underfull bins,
each time raising the sum of squared fills, until the number of bins meets a lower bound or no exchange
that raises the sum is left anywhere. Any underfull bin may give; nothing but these two ends the search.
The pieces of bins that stay underfull in their groups meet in a second round of the same.
Only lengths take part in packing; ids stay where they were made until sequences are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lean, materialize, sized_slices

CAPACITY = 2048


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut at the capacity.

    ids are little-endian unsigned 32-bit numbers. A null text is empty: its only id is the end.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glossa.llm.encoding import encoder

        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in sized_slices(batches, 1):
            row, piece, parts = [], [], []
            for k, ids in enumerate(enc.encode_batch([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    row.append(k)
                    piece.append(n)
                    parts.append(ids[at : at + 4 * capacity])
            length = pa.array([len(x) // 4 for x in parts], pa.int64())
            start = pa.array([n * capacity for n in piece], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), start, length, pa.array(parts, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, room left in each bin): best fit in falling length."""
    bins = np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = there >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                there ^= 1 << r
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        bins[i] = k
        room[k] = r - n
        if room[k]:
            by_room[room[k]].append(k)
            there |= 1 << room[k]
    return bins, np.array(room, np.int64)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins: for each least length that counts, pieces too large to share a bin, and the rest by volume."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    n, volume = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    alpha = np.arange(half + 1)
    alone = n[capacity] - n[half]  # over half of a bin
    middle_n, middle_volume = n[capacity - alpha] - n[half], volume[capacity - alpha] - volume[half]
    small = volume[half] - np.concatenate(([0], volume))[alpha]
    return int((alone + np.maximum(0, -(-(small - (middle_n * capacity - middle_volume)) // capacity))).max(initial=0))


def local_search(lengths: np.ndarray, bins: np.ndarray, room: np.ndarray, capacity: int) -> None:
    """Exchange in place until ``least_bins`` is met or no exchange raises the sum of squared fills.

    Every underfull bin gives in turn, the least filled first, as long as it can; sweeps over all of them
    go on until one changes nothing. The sum of squared fills is a rising integer, so the search ends.
    """
    least, changed = least_bins(lengths, capacity), True
    while changed and int((room < capacity).sum()) > least:
        changed = False
        fill = capacity - room
        given: set[tuple[int, ...]] = set()  # lengths of bins that could give nothing since the last change
        for donor in np.argsort(fill, kind="stable").tolist():
            while 0 < room[donor] < capacity:
                mine = np.flatnonzero(bins == donor)
                what = tuple(sorted(lengths[mine].tolist()))
                if what in given:
                    break
                if not _exchange(lengths, bins, room, donor, mine, capacity):
                    given.add(what)
                    break
                changed = True
                given.clear()
            if changed and int((room < capacity).sum()) <= least:
                return


def _exchange(lengths: np.ndarray, bins: np.ndarray, room: np.ndarray, donor: int, mine: np.ndarray, capacity: int) -> bool:
    """The exchange out of ``donor`` that raises the sum of squared fills most, done; False if none does.

    A gain g of a bin with fill f over the donor's fill d raises the sum by 2g(f - d + g).
    """
    others = np.flatnonzero((room[bins] > 0) & (bins != donor))
    if not len(others):
        return False
    at = bins[others]
    d = capacity - room[donor]
    used = np.unique(at)
    to = np.concatenate([at, used])  # one for another piece, or for nothing: a move
    back = np.concatenate([lengths[others], np.zeros(len(used), lengths.dtype)])
    one: dict[int, list[int]] = {}
    by_length: dict[int, list[int]] = {}
    for i in mine.tolist():
        one.setdefault(int(lengths[i]), [i])
        by_length.setdefault(int(lengths[i]), []).append(i)
    two = dict(one)
    sizes = sorted(by_length)
    for k, a in enumerate(sizes):
        for b in sizes[k:]:
            if a != b or len(by_length[a]) > 1:
                two.setdefault(a + b, [by_length[a][0], by_length[b][-1]])
    best, what = 0, None
    gives = np.array(sorted(two))
    most = back + room[to]
    k = np.searchsorted(gives, most, "right") - 1  # the most that fits is worth most
    gain = np.where(k >= 0, gives[np.maximum(k, 0)] - back, 0)
    worth = np.where(gain > 0, 2 * gain * (capacity - room[to] - d + gain), 0)
    j = int(worth.argmax())
    if worth[j] > 0:
        best, what = int(worth[j]), (two[int(gives[k[j]])], [int(others[j])] if j < len(others) else [], int(to[j]))
    if what is None:  # one for two: for each first piece the least second one that leaves room enough
        theirs = lengths[others]
        wide = int(capacity) + 2
        order = np.lexsort((theirs, at))
        key = (at * wide + theirs)[order]
        for v, give in one.items():
            need = np.maximum(v - room[at] - theirs, 1)
            k = np.searchsorted(key, at * wide + need)
            k = np.minimum(np.where(order[np.minimum(k, len(order) - 1)] == np.arange(len(at)), k + 1, k), len(order) - 1)
            second = order[k]
            gain = v - theirs - theirs[second]
            fine = (at[second] == at) & (second != np.arange(len(at))) & (gain > 0) & (gain <= room[at])
            worth = np.where(fine, 2 * gain * (capacity - room[at] - d + gain), 0)
            j = int(worth.argmax())
            if worth[j] > best:
                best, what = int(worth[j]), (give, [int(others[j]), int(others[second[j]])], int(at[j]))
    if what is None:
        return False
    give, take, target = what
    net = int(lengths[give].sum() - lengths[take].sum())
    bins[give], bins[take] = target, donor
    room[target] -= net
    room[donor] += net
    return True


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, fill of it) for each length; lengths are from 1 to the capacity."""
    bins, room = best_fit(lengths, capacity)
    local_search(lengths, bins, room, capacity)
    order = np.lexsort((-lengths, bins))
    upto = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate(([True], np.diff(bins[order]) != 0))
    offset = np.empty(len(lengths), np.int64)
    offset[order] = upto - np.repeat(upto[first], np.diff(np.concatenate((np.flatnonzero(first), [len(order)]))))
    return bins, offset, capacity - room[bins]


def _round(rows: DataFrame, n_groups: int, number: int, capacity: int) -> DataFrame:
    """Pack each group of ``rows``; the columns in ``rows`` stay, the three of a place are set.

    ``rows`` must be a written table: a row's group comes from its place in the files, which a task that is
    repeated finds again, so that ids that are null or repeat do not meet in one group.
    """
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "_fill", "_group")]
    at = names.index("length")

    def run(group: pa.Table) -> pa.Table:
        bins, offset, fill = pack_lengths(group.column(at).to_numpy(), capacity)
        base = (number << 58) + (group.column("_group")[0].as_py() << 30)
        return group.select(names).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offset)).append_column("_fill", pa.array(fill))

    kept = rows.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(n_groups)).alias("_group"))
    schema = rows.select(*names).schema.add("sequence_id", "long").add("offset", "long").add("_fill", "long")
    return kept.groupBy("_group").applyInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, length and what else is to be carried).

    ``pieces`` is written once, so that what made it is not repeated. Groups have ``group_rows`` rows
    on average, whatever the table's size and its ids. An empty table gives no rows.
    """
    pieces = materialize(pieces, "pieces")
    first = materialize(_round(pieces, max(1, -(-pieces.count() // group_rows)), 0, capacity), "packed")
    closed, left = first.filter(F.col("_fill") == capacity), first.filter(F.col("_fill") < capacity)
    again = _round(left, max(1, -(-left.count() // group_rows)), 1, capacity)
    return closed.unionByName(again).drop("_fill")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences from pieces with ids and their places. Needs unique ids."""
    whole = pieces.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset", "length"), ["doc_id", "piece"])
    parts = whole.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null ids and repeated rows keep their pieces; null and empty texts give one piece of one id.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
