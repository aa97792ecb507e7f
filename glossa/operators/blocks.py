"""Markdown blocks of a text, with code point offsets: a line scanner, one pass a document."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPAQUE = {"table", "code", "rule", "html"}
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][^>]*>|!--)")
_DELIMITER_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    kind: str
    start: int
    end: int


def _lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line without its end mark."""
    out, at = [], 0
    for piece in text.splitlines(keepends=True):
        out.append((at, at + len(piece.rstrip("\r\n\x0b\x0c\x1c\x1d\x1e\x85  "))))
        at += len(piece)
    return out


def segment(text: str) -> list[Block]:
    """Blocks in order; a wrapped paragraph, item or quote is one block. Each line without a blank is in one."""
    blocks: list[Block] = []
    lines = _lines(text)
    fence, k = None, 0
    open_kind = None  # a paragraph-like block that a next plain line goes on

    def add(kind: str, start: int, end: int, joins: bool = False) -> None:
        nonlocal open_kind
        if joins and blocks and open_kind == kind:
            blocks[-1].end = end
        else:
            blocks.append(Block(kind, start, end))
        open_kind = kind if kind in {"prose", "list_item", "blockquote", "code", "table", "html"} else None

    while k < len(lines):
        start, end = lines[k]
        line = text[start:end]
        k += 1
        if fence:
            blocks[-1].end = end
            if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", line):
                fence, open_kind = None, None
            continue
        if not line.strip():
            open_kind = None
            continue
        if m := _FENCE.match(line):
            add("code", start, end)
            fence = m[1]
        elif open_kind == "html" or (open_kind != "prose" and _HTML.match(line)):
            add("html", start, end, joins=True)
        elif open_kind == "prose" and _UNDERLINE.match(line):
            blocks[-1].kind, blocks[-1].end, open_kind = "heading", end, None
        elif _RULE.match(line):
            add("rule", start, end)
        elif _HEADING.match(line):
            add("heading", start, end)
        elif open_kind == "table" and "|" in line:
            add("table", start, end, joins=True)
        elif "|" in line and k < len(lines) and _DELIMITER_ROW.match(text[lines[k][0] : lines[k][1]]) and "|" in text[lines[k][0] : lines[k][1]]:
            add("table", start, lines[k][1])
            k += 1
        elif _QUOTE.match(line):
            add("blockquote", start, end, joins=True)
        elif (line.startswith("    ") or line.startswith("\t")) and open_kind in (None, "code") and not (blocks and blocks[-1].kind == "list_item"):
            add("code", start, end, joins=True)
        elif _ITEM.match(line):
            add("list_item", start, end)
        elif open_kind in {"prose", "list_item", "blockquote"}:
            blocks[-1].end = end
        else:
            add("prose", start, end)
    return blocks


def code_spans(text: str) -> list[tuple[int, int]]:
    """Inline code: a run of backticks up to the next run of equal length; an odd number of backslashes escapes."""
    runs = [(m.start(), m.end()) for m in re.finditer("`+", text)]
    out, k = [], 0
    while k < len(runs):
        start, end = runs[k]
        slashes = len(text[:start]) - len(text[:start].rstrip("\\"))
        if slashes % 2:
            start += 1
        closing = next((j for j in range(k + 1, len(runs)) if start < end and runs[j][1] - runs[j][0] == end - start), None)
        if closing is None:
            k += 1
        else:
            out.append((start, runs[closing][1]))
            k = closing + 1
    return out


def blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a block: ``keep`` columns, block_index, kind, start, end, text. Only texts go to Python."""
    kind = "array<struct<kind: string, start: int, end: int>>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": b.kind, "start": b.start, "end": b.end} for b in segment(t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    rows = docs.withColumn("_b", cut.asNondeterministic()(F.col("text"))).select(*keep, "text", F.posexplode("_b").alias("block_index", "b"))
    return rows.select(*keep, "block_index", "b.*", F.substr("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("text"))


def block_counts(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "kind").agg(F.count("*").alias("n"))
