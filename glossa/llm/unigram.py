"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces, log scores and flags come from a ``.model`` file. Files of merge rank (whose scores are ranks,
not probabilities) get ``-ln(rank + 1)`` instead, by Zipf's law. Blanks become the marker U+2581 and a
marker goes in front; characters that no piece covers become byte pieces.

No piece goes on after a blank or across a line feed, so that the best path of a text is the best paths
of its words one after the other. Each distinct word is searched once, many words at a time: all of
them step through the trie together, one byte at a step. Sums are in 32-bit floats, in the order in
which the library adds them. If a file has a piece that breaks this, whole texts are searched.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import slices

MARK = "▁"
#: Fixed values of the file format: kinds of pieces, kinds of models, the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(" +[^ \n]*|[^ \n]+|\n")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Pieces:
    """A vocabulary: texts of pieces, log scores, kinds; whether a marker is put in front."""

    texts: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool


def load_pieces(path: str) -> Pieces:
    texts, scores, kinds, unigram, prefix = [], [], [], True, True
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                piece = dict(fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                unigram = dict(fields(value)).get(3, UNIGRAM) == UNIGRAM
            elif number == 3:
                prefix = bool(dict(fields(value)).get(3, 1))
    found = np.array(scores, np.float32)
    if not unigram:
        ranked = np.array([k == NORMAL for k in kinds])
        order = np.flatnonzero(ranked)[np.argsort(-found[ranked], kind="stable")]
        found[order] = -np.log(np.arange(len(order)) + 1.0)
    return Pieces(texts, found, kinds, prefix)


class DoubleArray:
    """A trie over bytes in two arrays: from node s, byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, words: list[bytes]):
        order = sorted(range(len(words)), key=words.__getitem__)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free = sparse = 257  # from the first on all before are used; before the second, most; below 257 not every byte fits
        queue = [(0, 0, len(order), 0)]  # node, its words in the order, bytes so far
        for node, first, last, depth in queue:
            if first < last and len(words[order[first]]) == depth:
                value[node] = order[first]
                first += 1
            if first == last:
                continue
            groups, a = [], first
            while a < last:
                c = words[order[a]][depth]
                b = a + 1
                while b < last and words[order[b]][depth] == c:
                    b += 1
                groups.append((c + 1, a, b))
                a = b
            while used[free]:
                free += 1
            begin = at = max((free if len(groups) == 1 else max(free, sparse)) - groups[0][0], 0)
            while True:
                if at + 512 > size:
                    base, check, value = np.pad(base, (0, size)), np.pad(check, (0, size), constant_values=-1), np.pad(value, (0, size), constant_values=-1)
                    used.extend(bytes(size))
                    size *= 2
                if not any(used[at + c] for c, _, _ in groups):
                    break
                at += 1
            if len(groups) > 1 and at - begin > 16:
                sparse = at + groups[0][0]
            base[node] = at
            for c, a, b in groups:
                used[at + c] = 1
                check[at + c] = node
                queue.append((at + c, a, b, depth + 1))
        n = len(used) - next((k for k, u in enumerate(reversed(used)) if u), 0) + 257
        self.base, self.check, self.value = (np.pad(x, (0, max(0, n - len(x))), constant_values=-1)[:n] for x in (base, check, value))


class Remembered:
    """A mapping of bounded size in two generations: what is asked for stays, the rest goes in time.

    Keys over ``LONG`` characters are made for their batch alone, so that texts without blanks hold no memory.
    """

    LONG = 64

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.passing = limit, {}, {}, {}

    def ensure(self, keys: set[str], make) -> Callable[[str], bytes]:
        """The value of each of ``keys``; ``make`` gives the values of a list of new ones, all at once."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new = keys.difference(self.young)
        found = {k: self.old[k] for k in new if k in self.old}
        self.young.update(found)
        listed = list(new.difference(found))
        made = dict(zip(listed, make(listed), strict=True)) if listed else {}
        self.passing = {k: v for k, v in made.items() if len(k) > self.LONG}
        self.young.update((k, v) for k, v in made.items() if len(k) <= self.LONG)
        young, passing = self.young, self.passing
        return young.__getitem__ if not passing else lambda key: young[key] if key in young else passing[key]


class Unigram:
    """Encoder and decoder of one vocabulary; made once, sent to the workers."""

    def __init__(self, pieces: Pieces):
        usable = [i for i, k in enumerate(pieces.kinds) if k in (NORMAL, USER_DEFINED)]
        texts = [pieces.texts[i].encode() for i in usable]
        self.trie = DoubleArray(texts)
        self.ids = np.array(usable, np.int32)
        normal = pieces.scores[[i for i in usable if pieces.kinds[i] == NORMAL]]
        low, high = (float(normal.min()), float(normal.max())) if len(normal) else (0.0, 0.0)
        self.scores = np.array([pieces.scores[i] if pieces.kinds[i] == NORMAL else len(pieces.texts[i]) * high - 0.1 for i in usable], np.float32)
        self.unknown_score = np.float32(low - UNKNOWN_PENALTY)
        self.unknown_id = next((i for i, k in enumerate(pieces.kinds) if k == UNKNOWN), 0)
        self.byte_ids = np.full(256, -1, np.int64)
        for i, k in enumerate(pieces.kinds):
            if k == BYTE:
                self.byte_ids[int(pieces.texts[i][3:5], 16)] = i
        self.dummy_prefix = pieces.dummy_prefix
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|\n", pieces.texts[i]) for i in usable)
        self.shown = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else t.replace(MARK, " ").encode() for t, k in zip(pieces.texts, pieces.kinds, strict=True)]
        self.memo: Remembered | None = None

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian i32) of the best path of each UTF-8 word, ties to the earlier start."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):  # words of like length together, about a million bytes at a time
            n = max(1, min(len(order) - at, (1 << 20) // max(int(size[order[min(at + 4096, len(order) - 1)]]), 1)))
            some = order[at : at + n]
            for k, ids in zip(some.tolist(), self._paths([words[k] for k in some]), strict=True):
                out[k] = ids
            at += n
        return out

    def _paths(self, words: list[bytes]) -> list[bytes]:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        m, size = len(words), np.array([len(w) for w in words])
        wide = int(size.max())
        text = np.zeros((wide + 4, m), np.uint8)  # by position, as all words step together
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(m), size)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), word] = flat
        best = np.full((wide + 5, m), -np.inf, np.float32)
        best[0] = 0
        piece = np.full((wide + 5, m), -1, np.int32)
        came = np.zeros((wide + 5, m), np.int32)
        for i in range(wide):
            rows = np.flatnonzero((best[i] > -np.inf) & (i < size))
            if not len(rows):
                continue
            lead = text[i, rows]
            chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(m, bool)
            width = np.zeros(m, np.int64)
            width[rows] = chars
            here = best[i].copy()
            live, state, j = rows, np.zeros(len(rows), np.int64), i
            while len(live):
                to = base[state] + text[j, live].astype(np.int64) + 1
                fine = (check[to] == state) & (j < size[live])
                live, state = live[fine], to[fine]
                j += 1
                got = value[state]
                ends = np.flatnonzero(got >= 0)
                if len(ends):
                    r, g = live[ends], got[ends]
                    single[r[width[r] == j - i]] = True
                    score = self.scores[g] + here[r]
                    better = (score > best[j, r]) | (piece[j, r] == -1)
                    r = r[better]
                    best[j, r], piece[j, r], came[j, r] = score[better], g[better], i
            none = rows[~single[rows]]
            for n in np.unique(width[none]).tolist():
                r = none[width[none] == n]
                score = self.unknown_score + here[r]
                better = (score > best[i + n, r]) | (piece[i + n, r] == -1)
                r = r[better]
                best[i + n, r], piece[i + n, r], came[i + n, r] = score[better], -2, i
        found: list[list[np.ndarray]] = []
        at, live = size.copy(), np.flatnonzero(size)
        unknown = np.zeros(m, bool)
        while len(live):
            p, c = piece[at[live], live], came[at[live], live]
            unknown[live[p == -2]] = True
            column = np.full(m, -1, np.int64)
            column[live] = np.where(p == -2, -2 - c * 8 - (at[live] - c), self.ids[p])
            found.append(column)
            at[live] = c
            live = live[c > 0]
        table = np.array(found[::-1]).T if found else np.zeros((m, 0), np.int64)
        out = []
        for k, row in enumerate(table):
            row = row[row != -1]
            if unknown[k]:
                row = np.concatenate([self._bytes(words[k][(-2 - x) // 8 : (-2 - x) // 8 + (-2 - x) % 8]) if x < -1 else np.array([x]) for x in row.tolist()])
            out.append(row.astype("<i4").tobytes())
        return out

    def _bytes(self, char: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(char, np.uint8)]
        return ids if (ids >= 0).all() else np.array([self.unknown_id])

    @staticmethod
    def _keys(text: str) -> list[str]:
        """Words of a text that starts with its marker's blank: one leading blank is left out."""
        if "  " not in text and "\x01" not in text and "\x02" not in text:
            out: list[str] = []
            for n, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if n:
                    out.append("\n")
                if words[0]:
                    out.append("\x01" + words[0])
                out += words[1:]
            return out
        return [w if w == "\n" else "\x01" + w if w[0] != " " else w[1:] if w[1:2] not in (" ", "\x01", "\x02", "\n") else "\x02" + w for w in _WORDS.findall(text)]

    def _search(self, keys: list[str]) -> list[bytes]:
        words = [k if k == "\n" else k[1:] if k[:1] in ("\x01", "\x02") else " " + k for k in keys]
        return self.best_paths([w.replace(" ", MARK).encode() for w in words])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; an empty text has none."""
        shown = [(" " + t if self.dummy_prefix else t) if t else "" for t in texts]
        if not self.by_word:
            return self.best_paths([t.replace(" ", MARK).encode() for t in shown])
        self.memo = self.memo or Remembered(400_000)
        keys = [self._keys(t) if t else [] for t in shown]
        known = self.memo.ensure(set().union(*keys), self._search)
        return [b"".join(map(known, k)) for k in keys]

    def decode(self, ids: bytes) -> str:
        """The text of ids: markers are blanks again, byte pieces join to characters, the first blank goes."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def __getstate__(self):
        return self.__dict__ | {"memo": None}


def encode_documents(docs: DataFrame, model_path: str, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id), ``ids`` (little-endian i32) and ``decoded`` text of every row; null texts are empty.

    Repeated rows are each encoded; an empty table gives no rows; other columns are not read.
    """
    carry = carry or ["doc_id"]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Unigram(load_pieces(model_path)))  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 256):
            ids = model.encode_batch([x or "" for x in batch.column(len(carry)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())], [*carry, "ids", "decoded"])

    narrow = docs.select(*carry, F.col("text").alias("_text"))
    return narrow.mapInArrow(run, narrow.drop("_text").schema.add("ids", "binary").add("decoded", "string"))
