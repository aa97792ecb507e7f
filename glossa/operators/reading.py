"""One reading of a document: blocks, sentences and annotated tokens with places in the source text.

``read`` adds a struct column: each text is segmented, split into sentences inside its prose blocks and annotated
once. The finding rules walk ``prose`` themselves (``rules``), so that tokens need not leave Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import ABBREVIATIONS
from glossa.operators.annotate import WORD_TOKEN, annotate
from glossa.operators.blocks import OPAQUE, Block, code_spans, segment
from glossa.sources.profiles import STOP_LEMMAS

_STOP = re.compile(r"[.!?](?=\s|$)")
_ABBREVIATED = re.compile(r"(?:^|[\s(\[])(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.$", re.IGNORECASE)
_MARKER = {"heading": re.compile(r" {0,3}#{1,6}[ \t]+"), "list_item": re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+"), "blockquote": re.compile(r" {0,3}>[ \t]?")}
_STOPS = set(STOP_LEMMAS)
TOKEN = "struct<i: int, text: string, low: string, lemma: string, pos: string, tag: string, dep: string, head: int, start: int, end: int, word: boolean, kids: array<int>>"
REPEAT = "struct<lemma: string, n: int, start: int, end: int>"
OUTLINE = "array<struct<index: int, block: int, start: int, end: int, n_words: int>>"
SENTENCE = f"struct<index: int, block: int, start: int, end: int, text: string, n_words: int, tokens: array<{TOKEN}>>"
BLOCK = f"struct<index: int, kind: string, start: int, end: int, n_words: int, terms: array<string>, repeated: array<{REPEAT}>>"
READING = f"struct<sentences: array<{SENTENCE}>, blocks: array<{BLOCK}>, code: array<struct<start: int, end: int>>, repeated: array<{REPEAT}>>"


def sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Sentences of a range: cut after ``.!?`` before white space or the end, unless an abbreviation ends there."""
    out, at = [], start
    for m in _STOP.finditer(text, start, end):
        if text[m.start()] == "." and _ABBREVIATED.search(text, max(at, m.end() - 12), m.end()):
            continue
        out.append((at, m.end()))
        at = m.end()
    out.append((at, end))
    trimmed = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in out]
    return [(a, b) for a, b in trimmed if a < b]


def _tokens(text: str, start: int, end: int) -> list[dict]:
    toks = annotate(text[start:end])
    kids: list[list[int]] = [[] for _ in toks]
    for t in toks:
        if t["head"] != t["index"]:
            kids[t["head"]].append(t["index"])
    out = []
    for t, below in zip(toks, kids, strict=True):
        low, dep = t["text"].lower(), t["dep"]
        if low == "there" and t["index"] + 1 < len(toks) and toks[t["index"] + 1]["lemma"] == "be":
            dep = "expl"
        tag = "VB" if t["pos"] == "VERB" and low == t["lemma"] else t["pos"]
        at = start + t["start"]
        out.append({"i": t["index"], "text": t["text"], "low": low, "lemma": t["lemma"], "pos": t["pos"], "tag": tag, "dep": dep, "head": t["head"], "start": at, "end": at + len(t["text"]), "word": t["pos"] != "PUNCT", "kids": below})
    return out


def _repeats(content: list[tuple[str, int, int]]) -> list[dict]:
    counts, first = Counter(lemma for lemma, _, _ in content), {}
    for lemma, start, end in content:
        first.setdefault(lemma, (start, end))
    return [{"lemma": lemma, "n": n, "start": first[lemma][0], "end": first[lemma][1]} for lemma, n in sorted(counts.items()) if n > 1]


def prose(text: str) -> Iterator[tuple[int, Block, list[tuple[int, int]]]]:
    """(number, block, sentence spans) of each block; None as the spans of an opaque one."""
    for number, b in enumerate(segment(text)):
        if b.kind in OPAQUE:
            yield number, b, None
        else:
            mark = _MARKER[b.kind].match(text, b.start, b.end) if b.kind in _MARKER else None
            yield number, b, sentence_spans(text, mark.end() if mark else b.start, b.end)


def outline(text: str) -> list[dict]:
    """What ``reading`` has of sentences without their tokens; nothing is annotated, as a word token is one by its letters."""
    spans = [(number, x, y) for number, _, found in prose(text) for x, y in found or ()]
    return [{"index": k, "block": b, "start": x, "end": y, "n_words": sum(1 for _ in WORD_TOKEN.finditer(text, x, y))} for k, (b, x, y) in enumerate(spans)]


def reading(text: str) -> dict:
    """What ``READING`` describes, of one text; places are code points."""
    sentences, blocks, code, everything = [], [], [], []
    for number, b, spans in prose(text):
        row = {"index": number, "kind": b.kind, "start": b.start, "end": b.end, "n_words": 0, "terms": [], "repeated": []}
        blocks.append(row)
        if spans is None:
            code.append({"start": b.start, "end": b.end})
            continue
        content, terms = [], set()
        code += [{"start": b.start + x, "end": b.start + y} for x, y in code_spans(text[b.start : b.end])]
        for x, y in spans:
            toks = _tokens(text, x, y)
            words = [t for t in toks if t["word"]]
            sentences.append({"index": len(sentences), "block": number, "start": x, "end": y, "text": " ".join(text[x:y].split()), "n_words": len(words), "tokens": toks})
            row["n_words"] += len(words)
            terms.update(t["lemma"] for t in words if len(t["lemma"]) >= 4 and t["lemma"] not in _STOPS)
            content += [(t["lemma"], t["start"], t["end"]) for t in words if len(t["lemma"]) >= 7 and t["lemma"] not in _STOPS]
        row["terms"], row["repeated"] = sorted(terms), _repeats(content)
        everything += content
    return {"sentences": sentences, "blocks": blocks, "code": code, "repeated": _repeats(everything)}


def few(texts: pa.Array, most_bytes: int = 1 << 18) -> Iterator[pa.Array]:
    """The same texts in parts of about ``most_bytes``, one text at least: bounds what Python objects hold at a time."""
    at = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > most_bytes:
            yield texts.slice(at, k - at)
            at, held = k, 0
        held += n + 1
    if len(texts) > at:
        yield texts.slice(at)


def by_texts(make: Callable, kind: str, text: Column) -> Column:
    """A column of ``make(texts, the Arrow type)``, an array of the type ``kind``, of parts of the texts; a null text counts as an empty one."""
    made = T._parse_datatype_string(kind)

    @F.arrow_udf(made)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part in few(batch):
                yield make([t or "" for t in part.to_pylist()], to_arrow_type(made))

    return run.asNondeterministic()(text)


def by_text(make: Callable, kind: str, text: Column) -> Column:
    """A column of ``make(text)``, of the type ``kind``; a null text counts as an empty one."""
    return by_texts(lambda texts, made: pa.array([make(t) for t in texts], made), kind, text)


def read(docs: DataFrame, into: str = "reading") -> DataFrame:
    """``docs`` with the reading of its ``text``; a null text reads as an empty one."""
    return docs.withColumn(into, by_text(reading, READING, F.col("text")))
