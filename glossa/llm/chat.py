"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's nested field paths (``messages[].role``, ``data.dialog[].speaker``, ``prompt``) that any mapping
names are its layout; other fields do not count, so that ids, sources and weights do no harm. The SHA-256 of
the sorted paths is its fingerprint. Each known fingerprint names a mapping: which array holds the turns,
which fields are role and text and what its roles are called, or which flat fields become which role.
Canonical turns are then rendered by one template. Everything is DataFrame and SQL functions.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside a text get a
backslash after their first character; where backslashes stand there already, one more. Reading takes
one away, so that any text comes back as it was, and no text can open or close a turn.

Added columns: a caller's column with the name of an added one is kept as ``<name>_given``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: What must follow an opening character to make a control string.
CONTROL_TAILS = r"\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"
_ESCAPE = rf"([<\[]\\*)(?={CONTROL_TAILS})"
_UNESCAPE = rf"([<\[]\\*)\\(?={CONTROL_TAILS})"



@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: an array's items, or pairs of user and assistant texts and then flat fields."""

    array: str | None = None
    role: str = ""
    text: str = ""
    names: dict[str, str] = field(default_factory=dict)
    pairs: str | None = None
    flat: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        items = [f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"] if self.array else []
        return sorted(items + ([self.pairs] if self.pairs else []) + [f for _, f in self.flat])


#: Layouts. Flat fields without text give no turn, but for the first and the last.
LAYOUTS: dict[str, Mapping] = {
    "messages": Mapping("messages", "role", "content"),
    "conversations": Mapping("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    "turns": Mapping("turns", "role", "text"),
    "dialog": Mapping("data.dialog", "speaker", "utterance"),
    "prompt_response": Mapping(flat=(("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": Mapping(flat=(("user", "prompt"), ("assistant", "completion"))),
    "question_answer": Mapping(flat=(("user", "question"), ("assistant", "answer"))),
    "instruction": Mapping(flat=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    "instruction_only": Mapping(flat=(("user", "instruction"), ("assistant", "output"))),
    "system_prompt_response": Mapping(flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "prompt_history": Mapping(pairs="history", flat=(("user", "prompt"), ("assistant", "response"))),
}
#: Role names of other makers.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_TURNS = "array<struct<role: string, text: string>>"


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(record: Column, depth: int = 3) -> Column:
    """Nested field paths of a variant object, ``[]`` for what the items of an array have; null for anything else."""
    none = F.array().cast("array<string>")

    def under(x: Column) -> Column:
        key, value = x["key"], x["value"]
        items = F.array_distinct(F.flatten(F.transform(F.try_variant_get(value, "$", "array<map<string, variant>>"), lambda m: F.map_keys(m))))
        parts = [F.array(key), F.transform(F.coalesce(items, none), lambda p: F.concat(key, F.lit("[]."), p))]
        if depth > 1:
            parts.append(F.transform(F.coalesce(field_paths(value, depth - 1), none), lambda p: F.concat(key, F.lit("."), p)))
        return F.concat(*parts)

    return F.flatten(F.transform(F.map_entries(F.try_variant_get(record, "$", "map<string, variant>")), under))


def layout_fingerprint(record: Column) -> Column:
    """SHA-256 of those of a record's paths that some mapping names."""
    known = F.array(*[F.lit(p) for p in sorted({p for m in LAYOUTS.values() for p in m.paths})])
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(field_paths(record), known)), "\n"), 256)


def _mapped(record: Column, mapping: Mapping, more_names: dict[str, str]) -> Column:
    """array<struct<role, text>> by one mapping."""
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if mapping.array:
        items = F.try_variant_get(record, f"$.{mapping.array}", f"array<struct<`{mapping.role}`: string, `{mapping.text}`: string>>")
        names = more_names | mapping.names
        named = F.create_map(*[F.lit(v) for kv in names.items() for v in kv]) if names else None
        return F.transform(items, lambda x: turn(x[mapping.role] if named is None else F.coalesce(named[x[mapping.role]], x[mapping.role]), x[mapping.text]))
    flat = F.array(*[turn(F.lit(role), F.try_variant_get(record, f"$.{name}", "string")) for role, name in mapping.flat])
    flat = F.filter(flat, lambda x, i: (x["text"] != "") | (i == 0) | (i == len(mapping.flat) - 1))
    if not mapping.pairs:
        return flat
    earlier = F.transform(F.try_variant_get(record, f"$.{mapping.pairs}", "array<array<string>>"), lambda p: F.array(turn(F.lit("user"), F.get(p, 0)), turn(F.lit("assistant"), F.get(p, 1))))
    return F.concat(F.flatten(earlier), flat)


def _given(df: DataFrame, added: list[str]) -> DataFrame:
    """``df`` with columns that would clash renamed to ``<name>_given`` (and on, until the name is free)."""
    taken = set(df.columns) | set(added)
    for name in [c for c in df.columns if c in added]:
        new = f"{name}_given"
        while new in taken:
            new += "_given"
        taken.add(new)
        df = df.withColumnRenamed(name, new)
    return df


def canonical_turns(records: DataFrame, record_col: str = "record", rename_roles: bool = True) -> DataFrame:
    """Add ``layout`` (its name, null if unknown), ``layout_fingerprint`` and ``turns``.

    ``record_col`` is a variant, or a string of JSON. A record of an unknown layout (also one whose array of
    turns is empty), no JSON or null keeps its row with null ``layout`` and no turns, so that a caller can
    count or divert it. Null roles and texts are empty. ``rename_roles`` also turns role names of other
    makers into the usual ones, in any layout.
    """
    kind = dict(records.dtypes)[record_col]
    own = _given(records, ["layout", "layout_fingerprint", "turns", "_record_of_turns"])
    at = own.columns[records.columns.index(record_col)]
    record = F.try_parse_json(F.col(at)) if kind == "string" else F.col(at)
    seen = own.withColumn("_record_of_turns", record).withColumn("layout_fingerprint", layout_fingerprint(F.col("_record_of_turns")))
    layout, turns = None, None
    for name, mapping in LAYOUTS.items():
        hit = F.col("layout_fingerprint") == fingerprint_of(mapping.paths)
        value = _mapped(F.col("_record_of_turns"), mapping, ROLE_NAMES if rename_roles else {})
        layout = F.when(hit, F.lit(name)) if layout is None else layout.when(hit, F.lit(name))
        turns = F.when(hit, value) if turns is None else turns.when(hit, value)
    none = F.array().cast(_TURNS)
    return seen.withColumn("layout", layout).withColumn("turns", F.coalesce(turns.otherwise(none), none)).drop("_record_of_turns")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _escape_role(role: Column) -> Column:
    """Roles stand on one line: percent-coding leaves plain names as they are."""
    return F.url_encode(role)


def format_turns(df: DataFrame, turns: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``, array<struct<start, length>> in code points, 0-based.

    The loss mask covers the escaped text of each ``trained_role`` turn, without its markers. No turns give
    an empty text and no spans.
    """
    own = _given(df, ["formatted", "loss_spans", "_pieces"])
    turns = own.columns[df.columns.index(turns)]
    piece = F.transform(F.col(turns), lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    out = own.withColumn("_pieces", piece)
    out = out.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    folded = F.aggregate(
        F.transform("_pieces", lambda p: F.struct((p["role"] == trained_role).alias("on"), F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"))),
        start,
        lambda a, p: F.struct(
            (a["at"] + p["h"] + p["b"] + len(CLOSE)).alias("at"),
            F.when(p["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return out.withColumn("loss_spans", folded["spans"]).drop("_pieces")


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    body = F.transform(parts, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    return F.transform(body, lambda x: F.struct(F.url_decode(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def nest_turns(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Rows by turn to one record a conversation: (conv_id, record variant), in one of eight layouts.

    The layout goes by the id (modulo 5, null as 0) and by what it can hold without loss: flat layouts need
    their own order of roles and no empty text, the one that renames roles needs them free. Records also
    carry fields that no mapping names. Turns are ordered by (turn, role, text), nulls first; a null role or
    text is empty; repeated rows stay. A conversation is one row, as its formatted text is one string.
    """
    clean = rows.select(F.col(conv).alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_rows"))
    roles, texts = F.transform("_rows", lambda r: r["role"]), F.transform("_rows", lambda r: r["text"])
    made = grouped.select("conv_id", "_rows", roles.alias("_roles"), texts.alias("_texts"))
    n = F.size("_rows")
    text = lambda i: F.element_at("_texts", i)
    said = lambda *names: F.col("_roles") == F.array(*map(F.lit, names))
    whole = ~F.exists("_texts", lambda t: t == "")
    paired = (n >= 4) & (n % 2 == 0) & F.forall(F.transform("_roles", lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    names = F.create_map(*[F.lit(v) for canonical, name in (("user", "human"), ("assistant", "gpt")) for v in (canonical, name)])
    free = ~F.arrays_overlap("_roles", F.array(F.lit("human"), F.lit("gpt")))
    items = lambda role, body, rename=False: F.transform(
        "_rows", lambda r: F.struct((F.coalesce(names[r["role"]], r["role"]) if rename else r["role"]).alias(role), r["text"].alias(body), F.lit(1.0).alias("weight"))
    )
    record = lambda *fields: F.to_variant_object(F.struct(F.col("conv_id").alias("id"), F.lit("table").alias("origin"), *fields))
    slot = F.coalesce(F.pmod(F.col("conv_id").try_cast("long"), F.lit(5)), F.lit(0))
    history = F.transform(F.sequence(F.lit(1), F.greatest((n / 2).cast("int") - 1, F.lit(1))), lambda k: F.array(F.get("_texts", 2 * k - 2), F.get("_texts", 2 * k - 1)))
    out = (
        F.when((slot == 1) & free, record(items("from", "value", True).alias("conversations")))
        .when(slot == 2, record(items("role", "text").alias("turns")))
        .when(slot == 3, record(F.struct(items("speaker", "utterance").alias("dialog"), F.lit("x").alias("lang")).alias("data")))
        .when((slot == 4) & whole & said("user", "assistant"), record(text(1).alias("prompt"), text(2).alias("response")))
        .when((slot == 4) & whole & said("system", "user", "assistant"), record(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("response")))
        .when((slot == 4) & whole & paired, record(history.alias("history"), text(-2).alias("prompt"), text(-1).alias("response")))
        .otherwise(record(items("role", "content").alias("messages")))
    )
    return made.select("conv_id", out.alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows by turn to (conv_id, layout, layout_fingerprint, turns, formatted, loss_spans)."""
    return format_turns(canonical_turns(nest_turns(rows), rename_roles=False)).drop("record")


def probe_conversation(spark: SparkSession, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """Conversation -1: a user and an assistant row that both say control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
