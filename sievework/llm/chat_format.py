"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths, and a declared mapping turns each into turns.

A record's field paths (``messages[].role``), cut to the paths that any mapping knows, are sorted and hashed. The hash selects the mapping; if none has
exactly these paths, the first declared mapping whose paths are all there is taken. For typed tables this happens once, on the schema;
for JSON records it happens per record. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings of the template, and the tails by which a text's own ones are found.
OPEN, CLOSE, USER_OPEN, USER_CLOSE, ROLE_OPEN, ROLE_CLOSE = "<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>", "<</SYS>>"
TAILS = r"(/?s>|/?INST\]|</?SYS>>)"
#: Names of roles in known layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping. rows: one turn per row (conversation, order, role, text). items: a list of turns (list, role, text). parts: (role, fields joined by a blank line)."""

    name: str
    rows: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.items:
            return sorted([self.items[0], *(f"{self.items[0]}[].{x}" for x in self.items[1:])])
        return sorted(self.rows or {f for _, fields in self.parts for f in fields})


LAYOUTS = (
    Layout("turn_rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("dialogue", items=("dialogue", "speaker", "utterance")),
    Layout("system_prompt_completion", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction_input_output", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_output", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("question_answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
)
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def fingerprint(paths) -> int:
    """The signed 64-bit hash of the known ones among the paths, the same that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(",".join(sorted(set(paths) & set(KNOWN))), 42)
    return h - (1 << 64) if h >> 63 else h


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return []
    dot = f"{prefix}." if prefix else ""
    return [p for f in kind.fields for p in (dot + f.name, *schema_paths(f.dataType, dot + f.name))]


def layout_of(schema: T.StructType) -> Layout | None:
    paths = schema_paths(schema)
    exact = {fingerprint(x.paths): x for x in LAYOUTS}.get(fingerprint(paths))
    return exact or next((x for x in LAYOUTS if set(x.paths) <= set(paths)), None)


def _role(c: Column) -> Column:
    named = reduce(lambda w, kv: w.when(F.lower(c) == kv[0], kv[1]), ROLES.items(), F.when(F.lit(False), ""))
    return named.otherwise(F.coalesce(c, F.lit("")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, field, member) -> Column:
    """The turns of one record; field(name) is a text field's column, or the list itself, member(item, name) a text field of one of its items."""
    if layout.items:
        _, role, text = layout.items
        return F.coalesce(F.transform(field(layout.items[0]), lambda m: _turn(_role(member(m, role)), member(m, text))), F.array().cast(TURNS))
    # A part's empty fields leave no blank line; a system part that is empty is no turn.
    parts = [_turn(F.lit(role), F.concat_ws("\n\n", *(F.nullif(field(f).cast("string"), F.lit("")) for f in fields))) for role, fields in layout.parts]
    return F.filter(F.array(*parts), lambda t: (t["role"] != "system") | (t["text"] != ""))


#: What joins the texts of a content that is given in parts.
BETWEEN_PARTS = "\n"


def _id(c: Column, kind: T.DataType) -> Column:
    """Whole numbers as long, anything else as text."""
    return c.cast("long") if isinstance(kind, T.IntegralType) else c.cast("string")


def _typed_text(c: Column, kind: T.DataType | None) -> Column:
    """A typed content as text: of parts the texts, in order; parts without text are left out."""
    if not isinstance(kind, T.ArrayType):
        return c.cast("string")
    if isinstance(kind.elementType, T.StructType):
        if "text" not in kind.elementType.names:
            return F.lit(None).cast("string")
        return F.array_join(F.transform(c, lambda p: p["text"].cast("string")), BETWEEN_PARTS)
    return F.array_join(c.cast("array<string>"), BETWEEN_PARTS)


def turns_of_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of a typed table, one row per conversation.

    Turn rows are put in order of their turn (null first; ties by role, then text; repeated rows stay turns of their own). The rows of one
    conversation are one output row: its size is that of the conversation. Null role and null text count as empty; a null
    id is an id. conv_id is a long where the ids are whole numbers by type, else text as it stands. A content given as a list of parts is the parts' texts, joined by a newline; parts without text
    are left out. An empty table gives an empty result; columns that no mapping knows are not read. A schema that no mapping fits is an error.
    """
    layout = layout_of(df.schema)
    if layout is None:
        raise ValueError(f"no mapping for the fields {schema_paths(df.schema)}")
    name = F.lit(layout.name).alias("layout")
    if not layout.rows:
        item = df.schema[layout.items[0]].dataType.elementType if layout.items else None
        turns = _turns(layout, lambda f: F.col(f"`{f}`"), lambda m, f: _typed_text(m[f], item[f].dataType))
        return df.select(_id(F.col(f"`{id_col}`"), df.schema[id_col].dataType).alias("conv_id"), name, turns.alias("turns"))
    conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
    rows = df.select(_id(conv, df.schema[layout.rows[0]].dataType).alias("conv_id"), F.struct(turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", name, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _are_objects(elements: Column) -> Column:
    """Which elements of a list are objects, by their type: a string that holds JSON is a string."""
    return F.transform(elements, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))


def _json_text(item: Column, field: str) -> Column:
    """A field of a JSON object as text. A list counts as parts: of strings, and of objects the text."""
    parts = F.from_json(item, f"struct<`{field}`:array<string>>")[field]
    kinds = _are_objects(F.try_variant_get(F.try_parse_json(item), f"$.{field}", "array<variant>"))
    said = F.transform(parts, lambda p, i: F.when(F.coalesce(F.get(kinds, i), F.json_object_keys(p).isNotNull()), F.get_json_object(p, "$.text")).otherwise(p))
    return F.when(parts.isNotNull(), F.array_join(said, BETWEEN_PARTS)).otherwise(F.get_json_object(item, f"$.{field}"))


def turns_of_json(df: DataFrame, record_col: str = "record", id_path: str = "$.id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts, one row per record, repeated ones too.

    conv_id is the id as text, null where there is none. A record that is null, empty, no JSON object or of no known layout stays, with a null layout and no turns. Elements of a
    list of turns that are no objects are left out, strings that hold one too, the others stay. A content given as a list of parts is the parts' texts, joined by a newline; parts
    without text are left out. Other columns are not read. An empty table gives an empty result.
    """
    record = F.col(f"`{record_col}`").cast("string")
    lists = {x.items[0] for x in LAYOUTS if x.items}
    # Elements as JSON text, those that are objects.
    def as_list(f: str) -> Column:
        kinds = _are_objects(F.try_variant_get(F.try_parse_json(record), f"$.{f}", "array<variant>"))
        return F.filter(F.from_json(F.get_json_object(record, f"$.{f}"), "array<string>"), lambda m, i: F.coalesce(F.get(kinds, i), F.json_object_keys(m).isNotNull()))

    def nested(f: str) -> Column:
        of_one = lambda m: F.transform(F.json_object_keys(m), lambda k: F.concat(F.lit(f"{f}[]."), k))
        return F.coalesce(F.flatten(F.transform(as_list(f), of_one)), F.array().cast("array<string>"))

    paths = F.array_sort(F.array_intersect(F.concat(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), *map(nested, sorted(lists))), F.array(*map(F.lit, KNOWN))))
    df = df.select(F.get_json_object(record, id_path).alias("conv_id"), record.alias("record"), paths.alias("paths"))
    record = F.col("record")
    df = df.withColumn("fingerprint", F.xxhash64(F.array_join("paths", ",")))
    exact = [F.when(F.col("fingerprint") == fingerprint(x.paths), x.name) for x in LAYOUTS if not x.rows]
    within = [F.when(F.size(F.array_except(F.array(*map(F.lit, x.paths)), F.col("paths"))) == 0, x.name) for x in LAYOUTS if not x.rows]
    df = df.withColumn("layout", F.coalesce(*exact, *within))
    turns = F.when(F.lit(False), F.array().cast(TURNS))
    for x in LAYOUTS:
        if not x.rows:
            turns = turns.when(F.col("layout") == x.name, _turns(x, lambda f, x=x: as_list(f) if x.items else _json_text(record, f), _json_text))
    return df.select("conv_id", "layout", turns.otherwise(F.array().cast(TURNS)).alias("turns"))


def escape(c: Column) -> Column:
    """One more backslash after the first character of every control string, and of everything that looks like an escaped one."""
    return F.regexp_replace(c, F.lit(rf"([<\[])(\\*){TAILS}"), F.lit(r"$1\\$2$3"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(rf"([<\[])\\(\\*){TAILS}"), F.lit("$1$2$3"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, layout, turns) -> conv_id, layout, formatted, segments.

    formatted is the whole conversation; segments are its pieces in order, each with the flag loss, which is true for the texts of
    assistant turns only. Texts and roles are escaped, so the template's control strings stand only where it put them. A conversation without turns is empty text. Null ids and
    repeated conversations are rows like others. A conversation is one value, so its length is bounded by what one value may hold (2 GB). An empty table gives an empty result.
    """

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def rendered(t: Column) -> Column:
        role, no = t["role"], F.lit(False)
        head = F.when(role == "user", OPEN + USER_OPEN).when(role == "assistant", OPEN).otherwise(F.concat(F.lit(OPEN + ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE)))
        tail = F.when(role == "user", USER_CLOSE + CLOSE).otherwise(CLOSE)
        return F.array(segment(head, no), segment(escape(t["text"]), role == "assistant"), segment(tail, no))

    out = turns.select("conv_id", "layout", F.flatten(F.transform("turns", rendered)).alias("segments"))
    return out.select("conv_id", "layout", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation."""

    def turn(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, 1 << 30)
        role_end = F.instr(body, ROLE_CLOSE)
        user = _turn(F.lit("user"), unescape(F.substr(body, F.lit(len(USER_OPEN) + 1), F.length(body) - len(USER_OPEN) - len(USER_CLOSE))))
        other = _turn(unescape(F.substr(body, F.lit(len(ROLE_OPEN) + 1), role_end - len(ROLE_OPEN) - 1)), unescape(F.substr(body, role_end + len(ROLE_CLOSE))))
        return F.when(F.startswith(body, F.lit(USER_OPEN)), user).when(F.startswith(body, F.lit(ROLE_OPEN)), other).otherwise(_turn(F.lit("assistant"), unescape(body)))

    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
