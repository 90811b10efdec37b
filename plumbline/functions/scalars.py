"""Column functions: hashes, identifiers, case styles, text cleaning, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary") if not isinstance(c, str) else F.col(c).cast("binary"), 256)


def short_hash(c: Column, n_bytes: int = 8) -> Column:
    return F.substr(sha256(c), F.lit(1), F.lit(2 * n_bytes))


def composite_hash(*parts: Column) -> Column:
    return sha256(F.concat_ws("|", *parts))


def node_module(node_id: Column) -> Column:
    """The module of a node id: the text between the kind's prefix and the first dot."""
    return F.regexp_extract(node_id, r"^(?:fn|dt|io|mod):([^.]*)", 1)


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def quoted_identifier(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def sanitized(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def name_parts(c: Column) -> Column:
    return F.filter(F.split(c, r"[-_\s.]+"), lambda x: x != "")


def pascal_case(c: Column) -> Column:
    return F.array_join(F.transform(name_parts(c), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def camel_case(c: Column) -> Column:
    p = pascal_case(c)
    return F.concat(F.lower(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))


def kebab_case(c: Column) -> Column:
    return F.lower(F.array_join(name_parts(c), "-"))


def snake_case(c: Column) -> Column:
    return F.lower(F.array_join(name_parts(c), "_"))


def strip_thinking(c: Column) -> Column:
    """Drops closed <think> blocks and an unclosed one to the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", ""))


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\n", ""), r"\n?```$", "")


def embedded_object(c: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def without_keys(json: Column, keys: list[str]) -> Column:
    """A JSON object's top-level fields but ``keys``, as a map of raw values."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*keys) if keys else F.lit(True))


def canonical_map(m: Column) -> Column:
    """Entries in key order, so equal objects are equal arrays."""
    return F.array_sort(F.map_entries(m))


def canonical_json(json: Column, without: list[str] = (), more: Column | None = None) -> Column:
    """A JSON value's text with keys in order, without spaces, and numbers by value; without the
    given top-level keys of an object (``more`` is an array column of such). Null if it is no JSON."""
    v = F.try_parse_json(json)
    drop = F.array(*[F.lit(k) for k in without]).cast("array<string>")
    drop = drop if more is None else F.concat(drop, more)
    held = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(drop, k))
    fields = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(F.to_json(F.struct(k.alias("k"))), F.lit(":"), F.to_json(F.element_at(held, k))))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))).otherwise(F.to_json(v))


def deterministic_id(*parts: Column) -> Column:
    """An id of UUID form that follows from its parts."""
    h = sha256(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}))
    piece = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", piece(1, 8), piece(9, 4), F.concat(F.lit("4"), piece(14, 3)), F.concat(F.lit("8"), piece(18, 3)), piece(21, 12))


def strip_prose(c: Column) -> Column:
    """Code out of a reply: import and require lines go, ``export`` goes from its line, and from
    the first line of prose on all goes; blank lines at both ends go, and one wrapper (a
    function or class of which the last line is the closing brace) unless an export went."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n", -1)
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    imports = lambda x: trimmed(x).rlike(r"^import[ {]") | trimmed(x).rlike(r"^(?:const|let|var) .*require\(")
    prose = lambda x: trimmed(x).rlike(r"^(?:This |Note:|The above|Here )")
    kept = F.filter(lines, lambda x: ~imports(x))
    stop = F.array_position(F.transform(kept, prose), F.lit(True))
    kept = F.when(stop > 0, F.slice(kept, F.lit(1), (stop - 1).cast("int"))).otherwise(kept)
    exported = F.exists(kept, lambda x: trimmed(x).startswith("export "))
    kept = F.transform(kept, lambda x: F.when(trimmed(x).startswith("export "), F.regexp_replace(x, r"^(.*?)export ", "$1")).otherwise(x))
    ends = lambda t: F.regexp_replace(F.regexp_replace(t, r"^(?:[ \t\r]*\n)+", ""), r"(?:\n[ \t\r]*)+$", "")
    text = ends(F.array_join(kept, "\n"))
    body = F.split(text, "\n", -1)
    first, last = trimmed(F.get(body, F.lit(0))), trimmed(F.element_at(body, -1))
    wrapped = ~exported & (F.size(body) >= 3) & first.rlike(r"^(?:async function |function |class ).*\{$") & (last == "}")
    inner = F.transform(F.slice(body, F.lit(2), F.greatest(F.size(body) - 2, F.lit(0))), lambda x: F.regexp_replace(x, r"^(?:\t|  )", ""))
    return F.when(wrapped, ends(F.array_join(inner, "\n"))).otherwise(text)


def jittered(ms: Column, seed: Column, share: float = 0.25) -> Column:
    """A delay with up to ``share`` of it added, the same for equal seeds."""
    return (ms + ms * share * (F.pmod(F.xxhash64(seed), F.lit(1_000_000)) / 1_000_000)).cast("long")


def byte_units(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def backoff_ms(attempt: Column, base_ms: int = 2000, cap_ms: int = 30000) -> Column:
    return F.least(F.lit(cap_ms).cast("double"), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def gate_score(compiled: Column, passed: Column, total: Column, violations: Column, max_violations: int, confidence: Column, min_rate: float = 0.95) -> Column:
    """0 without compilation; near 1 when every gate holds; else half the pass rate."""
    rate = F.coalesce(F.try_divide(passed, total), F.lit(1.0))
    ok = (rate >= min_rate) & (violations <= max_violations)
    return F.when(~compiled, F.lit(0.0)).when(ok, F.least(F.lit(1.0), F.lit(0.95) + confidence * 0.05)).otherwise(rate * 0.5)


def violation_penalty(n: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - n * 0.1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def byte_cap(c: Column, n: int) -> Column:
    """The text up to n bytes of UTF-8, without a character that they would cut."""
    raw = c.cast("binary")
    last = lambda k: F.conv(F.hex(F.substring(raw, n + 1 - k, 1)), 16, 10).cast("int")
    cut = F.when(last(1) >= 0xC0, 1).when((last(1) >= 0x80) & (last(2) >= 0xE0), 2).when((last(1) >= 0x80) & (last(2) >= 0x80) & (last(2) < 0xC0) & (last(3) >= 0xF0), 3).otherwise(0)
    next_byte = F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int")
    split = next_byte.between(0x80, 0xBF)  # the byte after the cap goes on with a character
    kept = F.when(split, n - cut).otherwise(n)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.substr(raw, F.lit(1), kept).cast("string"))


#: What error texts say, in the order in which it counts.
RETRY = [("429|Too Many Requests", None), ("50[0234]|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout", True), ("40[0134]", False)]
DAILY_LIMIT = "tokens per day|TPD"


def is_retryable(error: Column) -> Column:
    """Whether a failed request is worth another try: rate limits but daily ones, server
    errors, an exceeded deadline and unknown ones are; client errors, a cancelled context and no
    error are not."""
    ended, late = error.contains("context canceled"), error.contains("context deadline exceeded")
    limited, server, client = (error.rlike(p) for p, _ in RETRY)
    return F.when(error.isNull() | ended, False).when(late, True).when(limited, ~error.rlike(DAILY_LIMIT)).when(server, True).otherwise(~client)


def wait_ms(request_tokens: Column, per_minute: int, budget_left: Column, window_age_ms: Column) -> Column:
    """How long to wait: for the next request token, else for the minute's end, else 100 ms."""
    rest = 60_000 - window_age_ms
    return F.when((request_tokens <= 0) & F.lit(per_minute > 0), F.lit(60_000 / max(per_minute, 1)).cast("long")).when((budget_left <= 0) & (rest > 0), rest.cast("long")).otherwise(F.lit(100).cast("long"))


def config_warnings(provider: Column, api_key: Column, temperature: Column, max_tokens: Column) -> Column:
    """What is odd about a configuration, as an array of texts."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    told = F.array(
        F.when(~blank(provider) & (provider != "none") & blank(api_key), F.concat(F.lit("no api_key for provider "), provider)),
        F.when(~temperature.between(0, 2), F.format_string("temperature %.2f is not within 0 and 2", temperature)),
        F.when(max_tokens < 0, F.format_string("max_tokens %d is negative", max_tokens)),
    )
    return F.array_compact(told)


def first_of(*cases: tuple[Column, str]) -> Column:
    """The label of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(s)) for c, s in cases])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def inherited(override: Column, base: Column) -> Column:
    """A setting of its own, or where that is null or blank the one it inherits."""
    return F.coalesce(F.when(F.trim(override.cast("string")) != "", override), base)


def sampled(trace: Column, ratio: float) -> Column:
    """Whether a trace is among the given share of all; the same for all its spans."""
    return F.pmod(F.xxhash64(trace), F.lit(1_000_000)) < int(ratio * 1_000_000)
