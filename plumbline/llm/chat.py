"""Operator 6: chat formatting by schema fingerprints, DataFrame functions only.

Records of any layout come as VARIANT values, from JSON text or from the columns of a table.
The nested field paths of a record (``messages[].role``) are read off its variant's schema. Each
declarative mapping names the paths that it needs; in order (those with most paths first) the
record's paths among a mapping's are hashed, and the first mapping whose own fingerprint that is
makes the turns (conv_id, turn, role, text). So keys, extra and deeper fields do no harm, and
rows of one table may follow different mappings.

Template of a turn: ``<s>[INST] role [/INST] text </s>``. Inside roles and texts a control
string gets one backslash in front of it (and of the backslashes it already has), so ``read``
gets the original back by taking one away. A template control always follows a space or
starts a turn, and so never has a backslash before it.

A conversation is made as parts of ``PART`` turn numbers; their concatenation in order is the
formatted conversation, so no task holds an unbounded conversation's turns, and a long
conversation is formatted by many tasks.

Defined cases: a record of no known layout, of no JSON, or null has one row with a null layout
and no turn, which the formatter leaves out; a record may have 128 MB, Spark's bound for VARIANT;
null text and null role count as empty; rows with a null conv_id form one
conversation; equal turn numbers are ordered by role, then text; repeated rows are turns of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

PART = 64
CONTROL = r"(</?s>|\[/?INST\])"
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns. ``paths`` are the field paths that it needs. ``turns``:
    (turn, role, text) fields of a record that is one turn; ("[]", list, role field, text field)
    for a list of messages, after (role, field) pairs if any; else (role, field) pairs."""

    name: str
    paths: tuple[str, ...]
    turns: tuple


MAPPINGS = [
    Mapping("turn_rows", ("role", "text", "turn"), ("turn", "role", "text")),
    Mapping("system_messages", ("messages[].content", "messages[].role", "system"), ("[]", "messages", "role", "content", ("system", "system"))),
    Mapping("messages", ("messages[].content", "messages[].role"), ("[]", "messages", "role", "content")),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), ("[]", "conversations", "from", "value")),
    Mapping("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
]
#: Role names of other layouts and their canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Fingerprints and their mappings, in the order in which they are tried.
REGISTRY = {fingerprint(m.paths): m for m in sorted(MAPPINGS, key=lambda m: -len(m.paths))}


def schema_paths(schema, prefix: str = "") -> list[str]:
    """The dotted paths of a schema's leaves; a list adds []."""
    out = []
    for f in schema.fields:
        t, p = f.dataType, prefix + f.name
        while t.typeName() == "array":
            t, p = t.elementType, p + "[]"
        out += schema_paths(t, p + ".") if t.typeName() == "struct" else [p]
    return out


def field_paths(record: Column) -> Column:
    """The sorted nested paths of a variant's leaves, from its schema's text: a fold over names,
    types and brackets that keeps the path of each open bracket."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`(?:[^`]|``)*`: |[^\s<>,`]+: |[A-Z]+<|>|[A-Z_]+)"))
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        top, at = F.element_at(acc["open"], -1), acc["at"]
        name = F.regexp_replace(F.regexp_replace(t, "^`|`?: $", ""), "``", "`")
        new = lambda open_, at_, out: F.struct(open_.alias("open"), at_.alias("at"), out.alias("out"))
        return (
            F.when(t.endswith(": "), new(acc["open"], F.concat(top, name), acc["out"]))
            .when(t == "OBJECT<", new(F.concat(acc["open"], F.array(F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit("."))))), at, acc["out"]))
            .when(t == "ARRAY<", new(F.concat(acc["open"], F.array(top)), F.concat(at, F.lit("[]")), acc["out"]))
            .when(t == ">", new(F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(1))), at, acc["out"]))
            .otherwise(new(acc["open"], at, F.concat(acc["out"], F.array(at))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["out"])))


def _hash(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n").cast("binary"), 256)


def chosen(paths: Column) -> Column:
    """The name of the first mapping whose fingerprint the record's paths among its own have."""
    out = None
    for f, m in REGISTRY.items():
        own = F.array(*map(F.lit, sorted(m.paths)))
        hit = _hash(F.array_intersect(own, paths)) == f
        out = F.when(hit, F.lit(m.name)) if out is None else out.when(hit, F.lit(m.name))
    return out


def _role(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in ROLES.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def _field(record: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{name}", kind)


def _turn(role: Column, text: Column, turn: Column | None = None) -> Column:
    at = F.lit(None).cast("long") if turn is None else turn
    return F.struct(at.alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(m: Mapping, record: Column) -> Column:
    if m.turns[0] == "[]":
        _, name, role, text, *before = m.turns
        said = F.transform(_field(record, name, "array<variant>"), lambda x: _turn(_role(_field(x, role)), _field(x, text)))
        first = [F.array(_turn(F.lit(r), _field(record, f))) for r, f in before]
        return F.concat(*first, said) if first else said
    if isinstance(m.turns[0], str):
        turn, role, text = m.turns
        return F.array(_turn(F.coalesce(_field(record, role), F.lit("")), _field(record, text), _field(record, turn, "long")))
    made = F.array(*[_turn(F.lit(r), _field(record, f)) for r, f in m.turns])
    return F.filter(made, lambda x: (x["role"] != "user") | (x["text"] != ""))


def variant_turns(df: DataFrame, record: str, key: Column) -> DataFrame:
    """(conv_id, layout, turn, role, text) of VARIANT records of mixed layouts. conv_id is the
    record's own where it has one, else ``key``."""
    rec = F.col(record)
    rows = df.select(key.cast("long").alias("_key"), rec.alias("_v"), field_paths(rec).alias("_paths")).withColumn("layout", chosen(F.col("_paths")))
    turns = None
    for m in REGISTRY.values():
        made = (F.col("layout") == m.name, _turns(m, F.col("_v")))
        turns = F.when(*made) if turns is None else turns.when(*made)
    own = F.when(F.array_contains("_paths", "conv_id"), _field(F.col("_v"), "conv_id", "long")).otherwise(F.col("_key"))
    rows = rows.select(own.alias("conv_id"), "layout", F.posexplode_outer(turns).alias("_at", "t"))
    turn = F.when(F.col("layout") == "turn_rows", F.col("t.turn")).otherwise(F.col("_at").cast("long"))
    return rows.select("conv_id", "layout", turn.alias("turn"), "t.role", "t.text")


def table_records(df: DataFrame) -> DataFrame:
    """A table's rows as VARIANT records (``record``), each field a column."""
    return df.select(F.to_variant_object(F.struct(*df.columns)).alias("record"))


def json_turns(df: DataFrame, record: str, key: str) -> DataFrame:
    """The turns of JSON texts."""
    return variant_turns(df.select(F.try_parse_json(F.col(record)).alias("_r"), F.col(key).alias("_k")), "_r", F.col("_k"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose columns are the fields of a known layout."""
    paths = set(schema_paths(df.schema))
    if not any(set(m.paths) <= paths for m in MAPPINGS):
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return variant_turns(table_records(df), "record", F.monotonically_increasing_id()).drop("layout")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(\\*)" + CONTROL, r"\\$1$2")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\*)" + CONTROL, "$1$2")


def format_parts(turns: DataFrame) -> DataFrame:
    """conv_id, part, formatted, spans (start and end in the part of each text to learn)."""
    t = turns.select("conv_id", F.floor(F.col("turn") / PART).alias("part"), F.struct("turn", "role", "text").alias("t"))
    rows = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = F.transform("ts", lambda x: F.struct((x["role"] == "assistant").alias("learn"), F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(MID)).alias("head"), escaped(x["text"]).alias("body")))
    rows = rows.withColumn("made", made)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
        F.when(x["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate("made", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), step, lambda acc: acc["spans"])
    return rows.select("conv_id", "part", F.array_join(F.transform("made", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"), spans.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted part."""
    pieces = F.filter(F.split(formatted, r"(?<= )</s>", -1), lambda p: p != "")
    mid = F.length(F.lit(MID))
    return F.transform(
        pieces,
        lambda p: F.aggregate(
            F.array(F.call_function("locate", F.lit(MID), p)),
            F.struct(F.lit("").alias("role"), F.lit("").alias("text")),
            lambda _, at: F.struct(unescaped(F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescaped(F.substr(p, at + mid, F.length(p) - at - mid)).alias("text")),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(parts: DataFrame) -> DataFrame:
    turns = read_turns(F.col("formatted"))
    rows = parts.select(
        "conv_id", "part", turns.alias("ts"), read_loss(F.col("formatted"), F.col("spans")).alias("loss"), F.length("formatted").alias("chars")
    ).select(
        "conv_id", "part", "chars", "loss", F.size("ts").alias("n"), F.array_join(F.transform("ts", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said")
    )
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c]), "")
    return rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sha2(whole("said").cast("binary"), 256).alias("turns_sha256"),
        F.sum(F.length("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
