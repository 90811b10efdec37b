"""Recorded fixtures against actual outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalars import canonical_json


def body_equal(expected: Column, actual: Column, ignore: list[str] = (), ignored: Column | None = None) -> Column:
    """Equal JSON values, whatever the order of keys and the spaces, without the ignored
    top-level keys (``ignored`` is an array column of more); where either is no JSON, equal
    strings. Numbers are equal by value, the order of arrays counts."""
    e, a = (canonical_json(c, list(ignore), ignored) for c in (expected, actual))
    same = expected.eqNullSafe(actual)
    return F.when(same, F.lit(True)).when(e.isNotNull() & a.isNotNull(), e == a).otherwise(F.lit(False))


def flat_headers(header: Column) -> Column:
    """The first value of each header of a map of arrays; an empty array gives an empty text."""
    return F.transform_values(header, lambda _, v: F.coalesce(F.get(v, F.lit(0)), F.lit("")))


def compare(df: DataFrame, ignore_fields: list[str] = (), ignore_headers: list[str] = (), rules: str | None = None) -> DataFrame:
    """Adds ``reason``, the first of status, header and body that differs, or null; a null
    expectation is not checked, a null status is none that was expected. Columns: expected_status, status, expected_header, header
    (maps), expected_body, body. A column ``http`` that is null gives the reason ``missing``.
    ``rules`` names a struct column (ignore_json_fields, ignore_header_fields) whose lists, where
    the struct is not null, replace the ones given."""
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    default = lambda xs: F.array(*[F.lit(x.strip()) for x in xs if x.strip()]).cast("array<string>")
    fields, heads = default(ignore_fields), default(ignore_headers)
    if rules:
        own = lambda c: trimmed(F.coalesce(F.col(f"{rules}.{c}"), F.array().cast("array<string>")))
        fields = F.when(F.col(rules).isNotNull(), own("ignore_json_fields")).otherwise(fields)
        heads = F.when(F.col(rules).isNotNull(), own("ignore_header_fields")).otherwise(heads)
    low = F.transform(heads, F.lower)
    want = F.map_filter(F.col("expected_header"), lambda k, _: ~F.array_contains(low, F.lower(k)))
    entries = F.map_entries("header")
    # of names that differ in case alone the first one's value counts
    other = lambda k: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == F.lower(k)), F.lit(0))["value"]
    have = lambda k: F.coalesce(F.try_element_at(F.col("header"), k), other(k))
    wrong = F.exists(F.map_entries(want), lambda e: ~F.coalesce(have(e["key"]) == e["value"], F.lit(False)))
    reason = F.coalesce(
        F.when(F.col("http").isNull(), "missing") if "http" in df.columns else F.lit(None).cast("string"),
        F.when(F.col("expected_status").isNotNull() & ~F.col("expected_status").eqNullSafe(F.col("status")), "status"),
        F.when(F.coalesce(wrong, F.lit(False)), "header"),
        F.when(F.col("expected_body").isNotNull() & ~body_equal(F.col("expected_body"), F.col("body"), (), fields), "body"),
    )
    return df.withColumn("reason", reason)
