"""Whole-text encoding with the tokenizers library, remembering what words encode to.

Both kinds of vocabulary split a text before merging, and never across the boundaries used here, so
that a text's ids are the ids of its pieces, one after the other. Arrow splits a batch of texts, finds
its distinct pieces and lays their ids out again; the library merges each distinct word once (while the
memory holds it). Texts with characters outside a plain set, whose normalisation or splitting might
depend on more, and texts with an added token's string go through the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which pieces are safe. Latin letters with marks, without the dotted
#: capital I (its lower case has two code points), and white space only as blank and line feed.
_PLAIN = re.compile("[\n -~ªµºÀ-ÖØ-öø-įı-ſ]*")
#: Runs of white space but the last, or one with a word after it, as byte-level splitting has them.
_PIECES = re.compile(" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
#: Within pieces of plain characters: what each kind of vocabulary merges inside.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_BYTE_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n{_LETTERS}0-9]+|[ \n]+(?![^ \n])|[ \n]")
_WORD_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^ \n{_LETTERS}0-9]+")
_MARKS = ".,;:!?)*$#%&|"
_REMEMBERED, _LONG = 250_000, 48


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that shows, else as the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


_ALPHABET = _byte_alphabet()


class Memo(dict):
    """What ``make`` gives for each key, remembered for short keys in two generations of a bounded size.

    What is asked for stays, the rest goes in time. Keys over ``_LONG`` characters are made anew each time,
    so that texts without white space hold no memory: at most ``2 * limit`` entries of bounded length.
    """

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.old = limit, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _LONG:
            self[key] = value
        return value

    def turn(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Encoder:
    """``encode_batch(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None  # some match after folding
        kind = (spec["pre_tokenizer"] or {}).get("type")
        steps = [x.get("type") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        names = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kind == "ByteLevel" and spec["normalizer"] is None and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.split, self.parts = self._byte_level, _BYTE_PARTS
        elif steps == ["Split", "ByteLevel"] and names == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed":
            self.split, self.parts = self._words, _WORD_PARTS
        else:
            self.split = self.parts = None
        self.before = "" if self.parts is _WORD_PARTS else " "
        self.tokens = Memo(_REMEMBERED // 4, self._merged)
        self.bases = Memo(_REMEMBERED, self._of_base)

    @staticmethod
    def _words(texts: list[str]) -> pa.ListArray:
        """White space is dropped and case folded; no token spans white space."""
        return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string()))))

    @staticmethod
    def _byte_level(texts: list[str]) -> pa.ListArray:
        """Pieces that start with a blank lose it; the others get a mark in front, but line feeds before a word."""
        odd = ["  " in x or "\n\n" in x or " \n" in x or "\n " in x or x[0] in " \n" or x[-1] in " \n" for x in texts]
        even = pa.array(["\x01" + x.replace("\n", " \n") for x, o in zip(texts, odd, strict=True) if not o], pa.large_string())
        rest = [[x[1:] if x[0] == " " and len(x) > 1 and x[1] not in " \n" else "\x01" + x for x in _PIECES.findall(t)] for t, o in zip(texts, odd, strict=True) if o]
        listed = pc.split_pattern(even, " ")
        if not rest:
            return listed
        at = np.empty(len(texts), np.int64)
        at[np.argsort(odd, kind="stable")] = np.arange(len(texts))
        return pa.concat_arrays([listed, pa.array(rest, listed.type)]).take(pa.array(at))

    def _restored(self, piece: str) -> str:
        if self.parts is _WORD_PARTS or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == "\x01" else " " + piece

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def _merged(self, part: str) -> bytes:
        """Ids of a part that is split and normalised already: the library's merging alone."""
        found = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(_ALPHABET))
        return pack(f"<{len(found)}I", *[x.id for x in found])

    def _of_base(self, base: str) -> bytes:
        """Ids of a word, which is one part, or of a whole piece of another kind."""
        if base.isalpha():  # so it is no contraction, and has no blank of its own
            return self._merged(self.before + base)
        return b"".join(map(self.tokens.__getitem__, self.parts.findall(self._restored(base))))

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces. Most are a word with marks after it; these are parts of their own."""
        word = pc.utf8_rtrim(pieces, _MARKS)
        plain = pc.utf8_is_alpha(word)
        based = pc.if_else(plain, word, pieces).dictionary_encode()
        known = pa.array(list(map(self.bases.__getitem__, _listed(based.dictionary))), pa.large_binary()).take(based.indices)
        n_marks = np.where(plain.to_numpy(zero_copy_only=False), (pc.binary_length(pieces).to_numpy() - pc.binary_length(word).to_numpy()), 0)
        kinds, kind = {"": 0}, np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(n_marks)
        for k, n, piece in zip(at.tolist(), n_marks[at].tolist(), _listed(pieces.take(pa.array(at))), strict=True):
            kind[k] = kinds.setdefault(piece[-n:], len(kinds))
        marks = pa.array([b"", *[self.tokens[x] for x in list(kinds)[1:]]], pa.large_binary()).take(pa.array(kind))
        return pc.binary_join_element_wise(known, marks, pa.scalar(b"", pa.large_binary()))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Distinct pieces of the whole batch are looked up once each; Arrow lays their ids out text by text."""
        has_added = self.added.search if self.added else lambda text: None
        fine = [k for k, x in enumerate(texts) if x and self.split and _PLAIN.fullmatch(x) and not has_added(x)]
        out: list[bytes] = [b""] * len(texts)
        if fine:
            self.bases.turn()
            self.tokens.turn()
            listed = self.split([texts[k] for k in fine])
            coded = listed.flatten().dictionary_encode()
            ids = self._of_pieces(coded.dictionary).take(coded.indices)
            _, ends, data = ids.buffers()
            data = memoryview(data if data is not None else b"")
            upto = np.frombuffer(ends, np.int64)[listed.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(fine) + 1)
            for k, first, last in zip(fine, upto, upto[1:], strict=False):
                out[k] = bytes(data[first:last])
        whole = sorted({k for k, x in enumerate(texts) if x}.difference(fine))
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


def _listed(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)
