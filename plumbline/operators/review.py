"""Reviews of generated code: scores, verdicts, mentions, snippets and reports.

Reports are frames of lines, a row each, so none is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Phrases that speak for and against a translation.
POSITIVE = ("equivalent", "semantically correct", "logic is preserved", "correctly translated", "matches the original", "faithful")
NEGATIVE = ("not equivalent", "missing", "incorrect", "differs", "does not match", "lost", "wrong")
#: The pattern of a name in upper-case text.
NAME = r"[A-Z0-9_-]+"
_SPACED = bytes(x if re.match(NAME, chr(x)) else 32 for x in range(256))
#: Distinct names that a task may hold, those that it looks for one by one, words that it remembers, and rows that it
#: holds before it gives them out, about.
TASK_NAMES, FEW_NAMES, HELD_WORDS, BATCH_ROWS = 100_000, 500, 200_000, 20_000


def _hits(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def _upper(c: Column) -> Column:
    """a-z only: ``upper`` also lengthens other letters."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def verdict(df: DataFrame, text: str) -> DataFrame:
    """Adds positive, negative, equivalent and reason. A JSON answer, or else the JSON object
    between its first { and last }, says ``equivalent`` and ``reason`` itself (false and empty
    where it says nothing); any other is equivalent with more phrases for than against, and not
    with neither."""
    shape = "equivalent boolean, reason string, _bad string"
    parsed = lambda c: F.from_json(c, shape, {"columnNameOfCorruptRecord": "_bad"})
    told, inner = parsed(F.col(text)), parsed(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0))
    good = lambda v, c: F.when(v["_bad"].isNull() & F.trim(c).startswith("{"), v)
    out = df.withColumn("positive", _hits(F.col(text), POSITIVE)).withColumn("negative", _hits(F.col(text), NEGATIVE))
    out = out.withColumn("_v", F.when(F.col(text).contains("{"), F.coalesce(good(told, F.col(text)), good(inner, F.lit("{")))))
    said = F.col("_v").isNotNull()
    equivalent = F.when(said, F.coalesce("_v.equivalent", F.lit(False))).otherwise(F.col("positive") > F.col("negative"))
    heard = F.col("positive") + F.col("negative") > 0
    reason = F.when(said, F.coalesce("_v.reason", F.lit(""))).when(heard, F.left(F.col(text), F.lit(150))).otherwise(F.concat(F.lit("could not parse verdict: "), F.left(F.coalesce(text, F.lit("")), F.lit(100))))
    return out.withColumn("equivalent", equivalent).withColumn("reason", reason).drop("_v")


def scored(items: DataFrame, scores: DataFrame, key: str, overall: Column, approve_at: float | None = None) -> DataFrame:
    """Items with their score, the overall one where there is none; those that reach
    ``approve_at`` are approved, others pending."""
    out = items.join(scores.select(key, "score"), key, "left").withColumn("score", F.coalesce("score", overall))
    return out.withColumn("status", F.when(F.col("score") >= approve_at, "approved").otherwise("pending") if approve_at is not None else F.lit("pending"))


def summary(items: DataFrame, by: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy(*by).agg(F.count("*").alias("total"), n("approved"), n("rejected"), n("regenerated"), n("pending"))


def report_items(items: DataFrame) -> DataFrame:
    """A JSON line for each item (module, function, score, status)."""
    return items.select(F.to_json(F.struct("module", "function", "score", "status", F.lit("").alias("feedback"))).alias("line"))


def report_document(items: DataFrame, project: str) -> DataFrame:
    """One JSON document of a review: counts by status and the items by module and function. A
    document is one text, so its items meet in one task; ``report_items`` gives them as rows."""
    n = lambda s: F.count_if(F.col("status") == s)
    item = F.struct("module", "function", "score", "status")
    got = items.agg(F.count("module").alias("total"), *[n(s).alias(s) for s in ("approved", "rejected", "regenerated", "pending")], F.array_sort(F.collect_list(item)).alias("items"))
    return got.select(F.to_json(F.struct(F.lit(project).alias("project"), "*")).alias("report"))


def _words(text: bytes) -> set[bytes]:
    return set(text.translate(_SPACED).split())


def _of_bodies(bodies: DataFrame, key: str, body: str, name: str, found: Callable[[bytes], Collection[bytes]]) -> DataFrame:
    """(key, name): what ``found`` gives for each body in upper case (a-z only)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(keys, at: list, names: list):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(names, pa.binary()).cast(pa.string())], names=[key, name])

        for b in batches:
            at, names = [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                if text:
                    got = found(text.upper())  # of bytes: a-z only
                    names += got
                    at += [i] * len(got)
                if len(at) >= BATCH_ROWS:
                    yield batch(b.column(0), at, names)
                    at, names = [], []
            if at:
                yield batch(b.column(0), at, names)

    return bodies.select(key, F.col(body).cast("binary").alias("_b")).mapInArrow(run, T.StructType([bodies.schema[key], T.StructField(name, T.StringType())]))


def _few(names: DataFrame) -> set[bytes] | None:
    """The distinct names where a task may hold them all."""
    rows = names.limit(TASK_NAMES + 1).collect()
    return None if len(rows) > TASK_NAMES else {r[0].encode() for r in rows if r[0] is not None}


def mentions(names: DataFrame, bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name): names that a body holds as a word, in any case. Words are made distinct
    within a body; many names are joined with them, few are held by each task."""
    wanted = names.select(_upper(F.col("name")).alias("name")).distinct()
    if (few := _few(wanted)) is not None:
        return _of_bodies(bodies, key, body, "name", lambda text: _words(text) & few)
    return _of_bodies(bodies, key, body, "name", _words).join(wanted, "name").select(key, "name")


def _parts(names: set[bytes]) -> Callable[[bytes], Collection[bytes]]:
    """Gives the names that lie in an upper-case text: a few are looked for one by one, of more those that
    lie in any of its words, of which short ones are remembered with theirs."""
    if len(names) <= FEW_NAMES:
        return lambda text: [n for n in names if n in text]
    known, letters, starts = {}, [n for n in names if len(n) == 1], {}
    for start, size in {(n[:2], len(n)) for n in names if len(n) > 1}:
        starts.setdefault(start, []).append(size)

    def found(text: bytes) -> set[bytes]:
        out = set()
        for w in _words(text):
            got = known.get(w)
            if got is None:
                got = {n for n in letters if n in w}
                for i in range(len(w) - 1):
                    for n in starts.get(w[i : i + 2], ()):
                        if (p := w[i : i + n]) in names:
                            got.add(p)
                if len(known) >= HELD_WORDS:
                    known.clear()
                if len(w) <= 64:
                    known[w] = got
            if got:
                out |= got
        return out

    return found


def contained(names: DataFrame, bodies: DataFrame, key: str, body: str, kind: str | None = "struct") -> DataFrame:
    """(key, name): names (name[, kind]) that a body holds anywhere, also inside a longer word, in
    any case; with ``kind`` only names of that kind. Names consist of NAME's characters, so one
    lies within one word. Where a task may hold all names, only those found leave a body; of more
    names, each distinct word's parts of their lengths are made, and an equi join finds them."""
    wanted = names.filter(F.col("kind") == kind) if kind and "kind" in names.columns else names
    wanted = wanted.select(_upper(F.col("name")).alias("name")).filter(F.col("name").rlike(f"^{NAME}$")).distinct()
    if (few := _few(wanted)) is not None:
        return _of_bodies(bodies, key, body, "name", _parts(few)).distinct()
    words = _of_bodies(bodies, key, body, "_w", _words)
    sizes = wanted.agg(F.coalesce(F.collect_set(F.length("name")), F.array().cast("array<int>"))).first()[0]  # one number a length
    every = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>"), lambda n: F.when(F.length("_w") >= n, F.transform(F.sequence(F.lit(1), F.length("_w") - n + 1), lambda i: F.substr("_w", i, n))).otherwise(F.array().cast("array<string>"))))
    parts = words.select("_w").distinct().select("_w", F.explode(F.array_distinct(every)).alias("name")).join(wanted, "name")
    return words.join(parts, "_w").select(key, "name").distinct()


def first_mentions(found: DataFrame, key: str, n: int) -> DataFrame:
    """The first n names of each body, by name: the feature of a prompt with bounded context."""
    return found.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("name"))).filter(F.col("_n") <= n).drop("_n")


def snippets(found: DataFrame, bodies: DataFrame, key: str, body: str, before: int = 5, after: int = 20) -> DataFrame:
    """(name, key, snippet): the first body that holds a name, and the lines around its first
    line there."""
    first = found.groupBy("name").agg(F.min(key).alias(key))
    lines = F.split(body, "\n", -1)
    j = first.join(bodies.select(key, body), key).withColumn("_lines", lines)
    at = F.array_position(F.transform("_lines", lambda x: F.array_contains(F.regexp_extract_all(_upper(x), F.lit(f"({NAME})")), F.col("name"))), True)
    start = F.greatest(at - before, F.lit(1)).cast("int")
    return j.select("name", key, F.array_join(F.slice("_lines", start, (at + after - start).cast("int")), "\n").alias("snippet"))


def incremental_report(classes: DataFrame) -> DataFrame:
    """Lines of a migration report from (path, class): a count of each class, then the files
    that are not unchanged. (part, line); lines are in order by both."""
    count = classes.groupBy("class").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.concat_ws(": ", "class", F.col("n").cast("string")).alias("line"))
    return count.unionByName(classes.filter("class <> 'unchanged'").select(F.lit(1).alias("part"), F.concat_ws(" ", "class", "path").alias("line")))


def class_lists(classes: DataFrame) -> DataFrame:
    """(class, path), each class's paths in order."""
    return classes.select("class", "path").orderBy("class", "path")


def metrics_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """Lines of a run's figures from one row of ``source_metrics`` and target files (path,
    content): what was read, what was written, and how much of it a file."""
    from plumbline.functions.scalars import byte_units

    one = F.lit(1).alias("_k")
    t = target.agg(F.count("*").alias("out_files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("out_bytes")).select("*", one)
    j = source.withColumn("_k", F.lit(1)).join(t, "_k")
    said = [("source files", F.col("files").cast("string")), ("source size", byte_units(F.col("bytes"))), ("modules", F.col("modules").cast("string")), ("functions", F.col("functions").cast("string")), ("generated files", F.col("out_files").cast("string")), ("generated size", byte_units(F.col("out_bytes"))), ("bytes a generated file", F.coalesce(F.try_divide(F.col("out_bytes"), F.col("out_files")).cast("long"), F.lit(0).cast("long")).cast("string"))]
    return j.select(F.posexplode(F.array(*[F.concat(F.lit(f"{n}: "), v) for n, v in said])).alias("ord", "line"))


def diff_report(changes: DataFrame) -> DataFrame:
    """Lines of a comparison from (path, change): + added, - removed, ~ modified."""
    mark = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    count = changes.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.concat_ws(": ", "change", F.col("n").cast("string")).alias("line"))
    return count.unionByName(changes.select(F.lit(1).alias("part"), F.concat_ws(" ", mark, "path").alias("line")))


def gates_report(results: DataFrame, key: str) -> DataFrame:
    """A line for each gate from (key, ord, gate, severity, status)."""
    return results.select(key, "ord", F.format_string("%-8s %s (%s)", F.upper("status"), "gate", "severity").alias("line"))


def source_metrics(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: files and bytes, and the records of their parse by kind."""
    n = lambda r: F.count_if(F.col("record") == r)
    one = F.lit(1).alias("_k")
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(F.col("content").cast("string"))), F.lit(0)).alias("bytes")).select("*", one)
    p = parsed.agg(n("module").alias("modules"), n("function").alias("functions"), n("data_type").alias("data_types"), n("io").alias("io"), n("call").alias("calls")).select("*", one)
    return f.join(p, "_k").drop("_k")
