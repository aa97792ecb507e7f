"""Token files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of 256 ids. A block stores
its least id, the offsets from it packed at the width that the 90th percentile of the offsets needs,
and a list of exceptions (position and whole offset) for the others. All is in little-endian 32-bit
words::

    "PFR1" | blocks | block starts (u64 words, in words) | documents | footer (6 x u64) | "PFR1"
    block: least id, width | count << 8 | exceptions << 20, packed words (8 lanes), positions, offsets
    documents: valid u8[n], doc_id i64[n], first token u64[n + 1]
    footer: tokens, blocks, documents, byte at which starts, documents and footer begin

The index of block starts lets a reader seek to any token. A file's name holds its task attempt; only
the files that the written manifest lists count, so that a task that is repeated does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import lean, materialize, shared_path, sized_slices

MAGIC = b"PFR1"
BLOCK, LANES = 256, 8
ROWS = BLOCK // LANES
PERCENTILE = 90
_CHUNK = 1024 * BLOCK  # ids that are coded at a time


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of a stream of u32 ids; the last block may be short."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    short = n_blocks * BLOCK - len(ids)
    value = np.concatenate([ids, np.full(short, ids[-1], np.uint32)]).reshape(n_blocks, BLOCK)
    least = value.min(1)
    value = value - least[:, None]
    bits = np.frexp(value.astype(np.float64))[1].astype(np.uint8)
    width = np.sort(bits, 1)[:, -(-PERCENTILE * BLOCK // 100) - 1].astype(np.int64)
    beyond = bits > width[:, None]
    n_beyond = beyond.sum(1)
    size = 2 + LANES * width + -(-n_beyond // 4) + n_beyond
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    count = np.full(n_blocks, BLOCK)
    count[-1] -= short
    out[start] = least
    out[start + 1] = width | count << 8 | n_beyond << 20
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            low = (value[at] & np.uint32((1 << w) - 1)).reshape(-1, ROWS, LANES)
            words = np.zeros((len(at), w, LANES), np.uint32)
            for j in range(ROWS):
                k, shift = divmod(j * w, 32)
                words[:, k] |= low[:, j] << np.uint32(shift)
                if shift + w > 32:
                    words[:, k + 1] |= low[:, j] >> np.uint32(32 - shift)
            out[(start[at] + 2)[:, None] + np.arange(LANES * w)] = words.reshape(len(at), -1)
    block, where = np.nonzero(beyond)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(n_beyond) - n_beyond, n_beyond)
        positions = start + 2 + LANES * width
        out.view(np.uint8)[4 * positions[block] + rank] = where
        out[(positions + -(-n_beyond // 4))[block] + rank] = value[block, where]
    return out, start


def unpack_blocks(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``start`` in ``words``."""
    if not len(start):
        return np.zeros(0, np.uint32)
    head = words[start + 1].astype(np.int64)
    width, count, n_beyond = head & 255, head >> 8 & 4095, head >> 20
    value = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        at = np.flatnonzero(width == w)
        packed = words[(start[at] + 2)[:, None] + np.arange(LANES * w)].reshape(-1, w, LANES)
        low, mask = np.empty((len(at), ROWS, LANES), np.uint32), np.uint32((1 << w) - 1)
        for j in range(ROWS):
            k, shift = divmod(j * w, 32)
            low[:, j] = packed[:, k] >> np.uint32(shift)
            if shift + w > 32:
                low[:, j] |= packed[:, k + 1] << np.uint32(32 - shift)
        value[at] = (low & mask).reshape(len(at), BLOCK)
    if n_beyond.any():
        block = np.repeat(np.arange(len(start)), n_beyond)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(n_beyond) - n_beyond, n_beyond)
        positions = start + 2 + LANES * width
        value[block, words.view(np.uint8)[4 * positions[block] + rank]] = words[(positions + -(-n_beyond // 4))[block] + rank]
    ids = (value + words[start][:, None]).ravel()
    return ids[: len(ids) - BLOCK + int(count[-1])]


class TokenFileWriter:
    """Writes one file as a stream; holds a chunk of ids, the block starts and the document table."""

    def __init__(self, out):
        self.out, self.held, self.n_held = out, [], 0
        self.words, self.tokens = 0, 0
        self.starts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.firsts = [0]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.doc_ids.append(doc_id)
        self.firsts.append(self.firsts[-1] + len(ids) // 4)
        if self.n_held >= _CHUNK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        words, start = pack_blocks(ids[:n])
        self.out.write(words.astype("<u4").tobytes())
        self.starts.append(start + self.words)
        self.words += len(words)
        self.tokens += n
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        starts = np.concatenate(self.starts).astype("<u8")
        valid = np.array([x is not None for x in self.doc_ids], np.uint8)
        at_starts = 4 + 4 * self.words
        at_docs = at_starts + 8 * len(starts)
        docs = valid.tobytes() + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array(self.firsts, "<u8").tobytes()
        footer = np.array([self.tokens, len(starts), len(valid), at_starts, at_docs, at_docs + len(docs)], "<u8")
        self.out.write(starts.tobytes() + docs + footer.tobytes() + MAGIC)


class TokenFile:
    """Reads a file's tables, and any range of its tokens by the block index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 52)
        tail = source.read(52)
        if tail[48:] != MAGIC:
            raise ValueError("not a token file")
        self.tokens, n_blocks, n_docs, at_starts, at_docs, _ = np.frombuffer(tail[:48], "<u8").astype(np.int64).tolist()
        self.end_words = (at_starts - 4) // 4
        source.seek(at_starts)
        self.starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)
        source.seek(at_docs)
        raw = source.read(n_docs * 9 + 8 * (n_docs + 1))
        self.valid = np.frombuffer(raw, np.uint8, n_docs).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, n_docs)
        self.firsts = np.frombuffer(raw, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (not included)."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        begin = int(self.starts[a])
        end = int(self.starts[b]) if b < len(self.starts) else self.end_words
        self.source.seek(4 + 4 * begin)
        ids = unpack_blocks(np.frombuffer(self.source.read(4 * (end - begin)), "<u4"), self.starts[a:b] - begin)
        return ids[first - a * BLOCK : last - a * BLOCK]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last one not included, their ids) for runs of documents of about a chunk."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            m = max(k + 1, int(np.searchsorted(self.firsts, self.firsts[k] + _CHUNK, "right")) - 1)
            m = min(m, n)
            yield k, m, self.read(int(self.firsts[k]), int(self.firsts[m]))
            k = m


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode ``docs`` in ascending doc_id into files in ``folder``; returns the manifest, a written table.

    Manifest: (shard, path, n_docs, n_tokens, start), start being the tokens of all files before it.
    One range of doc_id is one file. Null ids come first; equal ids are ordered by text; null texts
    are empty. ``folder`` is a URI that driver and executors share.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glossa.llm.encoding import encoder

        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        writer = out = None
        name = f"{folder}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfr"
        for batch in sized_slices(batches, 1):
            if writer is None:
                where, path = pafs.FileSystem.from_uri(name)
                where.create_dir(path.rpartition("/")[0], recursive=True)
                writer = TokenFileWriter(out := where.open_output_stream(path))
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            row = [[TaskContext.get().partitionId()], [name], [len(writer.doc_ids)], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    text = F.coalesce("text", F.lit("")).alias("text")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ranged.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return materialize(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files in a manifest."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = pafs.FileSystem.from_uri(path)
                with where.open_input_file(name) as source:
                    file = TokenFile(source)
                    for k, m, ids in file.documents():
                        raw, first = ids.astype("<u4").tobytes(), file.firsts[k : m + 1]
                        parts = [raw[4 * a : 4 * b] for a, b in zip((first[:-1] - first[0]).tolist(), (first[1:] - first[0]).tolist(), strict=True)]
                        arrays = [pa.array(file.doc_ids[k:m], pa.int64(), mask=~file.valid[k:m]), pa.array(start + first[:-1]), pa.array(np.diff(first)), pa.array(parts, pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    n = manifest.count()
    return manifest.select("path", "start").repartition(max(1, min(n, 10_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``docs``, read back from its token files.

    Repeated rows are each written; an empty table gives no files and no rows.
    """
    manifest = write_token_files(docs, shared_path(docs.sparkSession, "tokens"), tokenizer_path, end_id)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
