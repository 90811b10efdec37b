"""Pattern-based detection and masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# The patterns by type, in the order in which masking takes precedence. A word
# boundary is written as look-arounds over ASCII word characters, so a letter beyond ASCII
# beside a match is a boundary as well.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_ANY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
PATTERNS = {
    "ssn": rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}",
    "credit_card": rf"{_B}(?:\d{{4}}[-\s]?){{3}}\d{{4}}{_E}",
    "email": rf"{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_ANY}",
    "phone": _ANY + r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}" + _E,
    "ip_address": rf"{_B}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{_E}",
    "date_of_birth": rf"{_B}(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{{2}}{_E}",
    "account_number": rf"{_B}[A-Z]{{0,3}}\d{{8,17}}{_E}",
}


#: What any match of a kind holds: a cheap test of a text before its costly pattern.
HINTS = {"ssn": r"[0-9]{3}-", "credit_card": r"[0-9]{4}", "email": "@", "phone": r"[0-9]{3}", "ip_address": r"[0-9]\.[0-9]", "date_of_birth": r"[/-](?:19|20)[0-9]", "account_number": r"[0-9]{8}"}


def _hinted(text: Column, kind: str, pattern: str) -> Column:
    """Whether a text may hold a match: false only where it holds none."""
    if PATTERNS.get(kind) != pattern:
        return F.lit(True)
    return text.contains("@") if kind == "email" else text.rlike(HINTS[kind])


def detect(df: DataFrame, text: str, keep: list[str], types: tuple[str, ...] = (), custom: dict[str, str] | None = None) -> DataFrame:
    """One row per match: keep, type, value. No types means all; custom patterns come in
    addition or in place of those of their name."""
    patterns = PATTERNS | (custom or {})

    def hits(kind: str, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
        return F.when(_hinted(F.col(text), kind, pattern), found).otherwise(F.array().cast("array<struct<type:string,value:string>>"))

    found = [hits(t, p) for t, p in patterns.items() if not types or t in types]
    return df.filter(F.col(text).isNotNull()).select(*keep, F.explode(F.concat(*found)).alias("m")).select(*keep, "m.type", "m.value")


def locate(df: DataFrame, text: str, keep: list[str], types: tuple[str, ...] = (), custom: dict[str, str] | None = None) -> DataFrame:
    """``detect`` with places: keep, type, value, start, end (code points, the end exclusive), each
    kind looked for on its own, so matches of two kinds may overlap. Custom patterns match no empty text. A null or empty text has none;
    repeated rows give their matches each. Splitting a text by a pattern gives the part before each
    match, and a running sum over a row's matches their places; only these are shuffled, no text."""
    patterns = PATTERNS | (custom or {})
    none = F.array().cast("array<struct<type:string,i:int,before:int,value:string>>")

    def hits(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(values)), values, lambda b, v: F.struct(b.alias("b"), v.alias("v")))
        found = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("type"), i.alias("i"), F.length(x["b"]).alias("before"), x["v"].alias("value")))
        return F.when(_hinted(F.col(text), kind, pattern), found).otherwise(none)

    found = [hits(t, p) for t, p in patterns.items() if not types or t in types]
    rows = df.filter(F.col(text).isNotNull()).select(*keep, F.monotonically_increasing_id().alias("_row"), F.concat(*found).alias("_m"))
    rows = rows.select(*keep, "_row", F.explode("_m").alias("_m"))  # a step of its own: the number is a row's, not a match's
    upto = W.partitionBy("_row", "_m.type").orderBy("_m.i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("_m.before") + F.length("_m.value")).over(upto)
    rows = rows.select(*keep, F.col("_m.type").alias("type"), F.col("_m.value").alias("value"), end.alias("end"))
    return rows.select(*keep, "type", "value", (F.col("end") - F.length("value")).alias("start"), "end")


def mask_once(text: Column, style: str = "redact", types: tuple[str, ...] = ()) -> Column:
    """The text with its personal data masked in one pass from left to right, judged on the text as
    it is: where kinds overlap the match that starts first goes, of those that start together the kind
    listed first, and a mask is never masked again. Null stays null."""
    kinds = [t for t in PATTERNS if not types or t in types]
    if not kinds:
        return text
    any_of = "|".join(f"({PATTERNS[t]})" for t in kinds)

    def masks(group: int, kind: str) -> Column:
        # a kind's group is empty in the matches of all other kinds, and no match is empty
        return F.transform(F.regexp_extract_all(text, F.lit(any_of), F.lit(group)), lambda v: F.when(v != "", masked_value(v, F.lit(kind), style)))

    chosen = masks(1, kinds[0])
    for k, t in enumerate(kinds[1:]):
        chosen = F.zip_with(chosen, masks(k + 2, t), lambda a, b: F.coalesce(a, b))
    # one more part than matches: the last one has nothing behind it
    whole = F.array_join(F.zip_with(F.split(text, any_of, -1), chosen, lambda part, m: F.concat(part, F.coalesce(m, F.lit("")))), "")
    hinted = F.lit(False)
    for t in kinds:
        hinted = hinted | _hinted(text, t, PATTERNS[t])
    return F.when(hinted, whole).otherwise(text)


def mask_text(text: Column, types: tuple[str, ...] = ()) -> Column:
    """The text with each match replaced, kind after kind. A kind is looked for only where the
    original text has its hint; replacing other kinds makes no new hint."""
    out = text
    for t, p in PATTERNS.items():
        if not types or t in types:
            hint = _hinted(text, t, p)
            out = F.get(F.transform(F.array(out), lambda x: F.when(hint, F.regexp_replace(x, p, f"[REDACTED:{t}]")).otherwise(x)), F.lit(0))  # noqa: B023
    return out


def masked_value(value: Column, kind: Column, style: str) -> Column:
    short = lambda n: F.substr(F.sha2(value.cast("binary"), 256), F.lit(1), F.lit(n))
    if style == "hash":
        return F.concat(F.lit("HASH:"), short(16))
    if style == "token":
        return F.concat(F.lit("TOKEN:"), kind, F.lit(":"), short(8))
    if style == "redact":
        return F.concat(F.lit("[REDACTED:"), kind, F.lit("]"))
    digits = F.regexp_replace(value, r"\D", "")
    at = F.split(value, "@")
    return (
        F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value)))
        .when(kind == "credit_card", F.concat(F.lit("****-****-****-"), F.right(F.regexp_replace(value, "[- ]", ""), F.lit(4))))
        .when(kind == "ssn", F.concat(F.lit("***-**-"), F.right(value, F.lit(4))))
        .when((kind == "email") & (F.size(at) == 2), F.concat(F.left(value, F.lit(1)), F.lit("***@"), at[1]))
        .when(kind == "phone", F.concat(F.lit("(***) ***-"), F.right(digits, F.lit(4))))
        .otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), F.length(value) - 2), F.right(value, F.lit(1))))
    )


def mask_table(df: DataFrame) -> DataFrame:
    """Masks every string column."""
    return df.select(*[mask_text(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields])


def mask_nested(value: Column, kind: DataType, types: tuple[str, ...] = ()) -> Column:
    """Masks every string inside structs, arrays and map values; the shape and nulls stay."""
    if isinstance(kind, StringType):
        return mask_text(value, types)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[mask_nested(value.getField(f.name), f.dataType, types).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: mask_nested(x, kind.elementType, types))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: mask_nested(x, kind.valueType, types))
    return value


def nested_strings(value: Column, kind: DataType, path: Column) -> Column | None:
    """array<struct<path, value>> of all strings inside, as ``a.b[0]``; None if there can be none."""
    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(none)
    if isinstance(kind, StructType):
        parts = [nested_strings(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, ArrayType):
        if nested_strings(value, kind.elementType, path) is None:
            return None
        inside = F.transform(value, lambda x, i: nested_strings(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inside), none)
    if isinstance(kind, MapType):
        if nested_strings(value, kind.valueType, path) is None:
            return None
        inside = F.transform(F.map_entries(value), lambda e: nested_strings(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(inside), none)
    return None


def detect_nested(df: DataFrame, keep: list[str], types: tuple[str, ...] = ()) -> DataFrame:
    """One row per match in any column, however deep: keep, path, type, value."""
    parts = [nested_strings(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name not in keep]
    parts = [p for p in parts if p is not None]
    strings = F.concat(*parts) if parts else F.array().cast("array<struct<path:string,value:string>>")
    flat = df.select(*keep, F.explode(strings).alias("s")).select(*keep, F.col("s.path").alias("path"), F.col("s.value").alias("value"))
    return detect(flat, "value", [*keep, "path"], types)
