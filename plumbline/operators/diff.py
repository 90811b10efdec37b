"""Keyed comparisons of tables, file sets and stages, and line diffs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def _aligned(before: DataFrame, after: DataFrame, keys: list[str]) -> tuple[list[str], DataFrame, DataFrame]:
    """The columns of either side but the keys, in order, and both sides with all of them as
    text; one that a side lacks is null there."""
    cols = sorted(c for c in set(before.columns) | set(after.columns) if c not in keys)
    text = lambda df: df.select(*keys, *[(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in cols])
    return cols, text(before), text(after)


def _matched(b: DataFrame, a: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of equal keys; null keys are equal to each other."""
    on = reduce(lambda x, y: x & y, [F.col(f"b.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in keys])
    return b.alias("b").join(a.alias("a"), on, how)


def row_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed key: inserted, deleted or modified. Values are compared as text over
    the columns of both sides; nulls are equal, and null keys match each other."""
    cols, b, a = _aligned(before, after, keys)
    whole = F.struct(*cols) if cols else F.lit(0)
    side = lambda df, name: df.select(*keys, whole.alias(name), F.lit(True).alias(f"_in{name}"))
    j = _matched(side(b, "_b"), side(a, "_a"), keys, "full_outer")
    kind = F.when(F.col("_in_b").isNull(), "inserted").when(F.col("_in_a").isNull(), "deleted").when(~F.col("_b").eqNullSafe(F.col("_a")), "modified")
    key = lambda k: F.when(F.col("_in_b").isNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k)
    return j.select(*map(key, keys), kind.alias("change")).filter(F.col("change").isNotNull())


def column_diff(before: DataFrame, after: DataFrame, keys: list[str], table: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """One row per changed cell of keys on both sides; ``allowed`` holds table.col or *.col
    (any case), and changes there are no violations."""
    cols, b, a = _aligned(before, after, keys)
    j = _matched(b, a, keys, "inner")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"b.`{c}`").alias("old"), F.col(f"a.`{c}`").alias("new")) for c in cols])
    key = [F.col(f"b.`{k}`").alias(k) for k in keys]
    changed = j.select(*key, F.explode(F.filter(cells, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("x")).select(*keys, "x.col", "x.old", "x.new")
    low = [x.lower() for x in allowed]
    name = F.lower(F.col("col"))
    ok = F.concat(F.lit(table.lower() + "."), name).isin(*low) | F.concat(F.lit("*."), name).isin(*low) if low else F.lit(False)
    return changed.withColumn("violation", ~ok)


def tables_diff(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(tbl, key, change) over the tables of ``before``; the key columns as JSON. A table that
    ``after`` lacks is one row of the change ``missing table``."""
    out = []
    for t, b in before.items():
        if t in after:
            d = row_diff(b, after[t], keys[t])
            out.append(d.select(F.lit(t).alias("tbl"), F.to_json(F.struct(*keys[t]), {"ignoreNullFields": "false"}).alias("key"), "change"))
        else:
            out.append(b.sparkSession.createDataFrame([(t, None, "missing table")], "tbl string, key string, change string"))
    return all_tables(out)


def summary_text(diffs: DataFrame, by: list[str]) -> DataFrame:
    """(by, summary): what changed in words, as ``2 inserted, 1 modified``; no changes, no row."""
    n = diff_summary(diffs, by)
    said = [F.when(F.col(k) > 0, F.concat_ws(" ", F.col(k).cast("string"), F.lit(k))) for k in ("inserted", "deleted", "modified")]
    return n.select(*by, F.array_join(F.array_compact(F.array(*said)), ", ").alias("summary"))


def diff_summary(diffs: DataFrame, by: list[str]) -> DataFrame:
    count = lambda k: F.count_if(F.col("change") == k).alias(k)
    return diffs.groupBy(*by).agg(count("inserted"), count("deleted"), count("modified"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, hash) sets: added, removed, modified."""
    j = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return j.select("path", kind.alias("change")).filter(F.col("change").isNotNull())


def in_order(changes: DataFrame) -> DataFrame:
    """File changes by path."""
    return changes.orderBy("path")


def stage_delta(old: DataFrame, new: DataFrame, key: str, values: list[str], status: str | None = None) -> DataFrame:
    """New stages against old ones; an absent old stage counts as 0 (removed ones are not told).
    With ``status`` also old_status, new_status and whether they differ; a new stage's does."""
    more = [F.col(status).alias("_status")] if status else []
    o = old.select(key, *[F.col(v).alias(f"_{v}") for v in values], *more, F.lit(True).alias("_was"))
    told = [F.coalesce("_status", F.lit("")).alias("old_status"), F.col(status).alias("new_status"), (~F.col("_status").eqNullSafe(F.col(status))).alias("status_changed")] if status else []
    return new.join(o, key, "left").select(key, *[(F.col(v) - F.coalesce(f"_{v}", F.lit(0))).alias(f"{v}_delta") for v in values], F.col("_was").isNull().alias("is_new"), *told)


def files_summary(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: files by change (path, change), and the sums of lines (path,
    lines_added, lines_removed; a path without counts adds nothing)."""
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return changes.join(lines, "path", "left").agg(n("added"), n("removed"), n("modified"), total("lines_added"), total("lines_removed"))


def line_counts(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Lines as kept, removed or added, by the longest common subsequence; of equally long
    ones that which adds later lines first when read backwards. Common last lines are set aside
    first, as the script ends with them in any case. Of the table over lines that both sides
    have, a row at a time is held, and two bits a cell say where to go from it."""
    end = 0
    while end < min(len(old), len(new)) and old[-1 - end] == new[-1 - end]:
        end += 1
    tail = [(" ", x) for x in old[len(old) - end :]]
    old, new = old[: len(old) - end], new[: len(new) - end]
    both = {x: i for i, x in enumerate(set(old) & set(new))}
    a, b = (np.array([both[x] for x in side if x in both], np.int64) for side in (old, new))
    p, q = ([0, *accumulate(x in both for x in side)] for side in (old, new))
    row = np.zeros(len(b) + 1, np.int64)
    left, less = [np.packbits(np.ones(len(b) + 1, bool))], [np.packbits(np.ones(len(b) + 1, bool))]
    for x in a:
        best = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        new_row = np.append(0, np.maximum.accumulate(best)) if len(b) else row
        left.append(np.packbits(np.append(True, new_row[:-1] == new_row[1:])))  # adding loses nothing
        less.append(np.packbits(np.append(True, new_row[:-1] >= row[1:])))  # as good as removing
        row = new_row
    bit = lambda bits, i, j: bool(bits[i][j >> 3] >> (7 - (j & 7)) & 1)
    out, i, j = [], len(old), len(new)
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append((" ", old[i]))
            continue
        if not i or not j:
            add = not i
        elif new[j - 1] not in both:
            add = True
        else:
            add = bit(less if old[i - 1] in both else left, p[i], q[j])
        if add:
            j -= 1
            out.append(("+", new[j]))
        else:
            i -= 1
            out.append(("-", old[i]))
    return out[::-1] + tail


def hunks(script: list[tuple[str, str]], context: int = 3) -> list[tuple[int, int]]:
    """Ranges of the script around changes; a new one where the gap exceeds twice the context."""
    at = [k for k, (c, _) in enumerate(script) if c != " "]
    out: list[list[int]] = []
    for k in at:
        if out and k - out[-1][1] <= 2 * context:
            out[-1][1] = k
        else:
            out.append([k, k])
    return [(max(0, a - context), min(len(script), b + context + 1)) for a, b in out]


def _scripts(pairs: DataFrame, key: str, made, schema: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):  # a pair at a time: texts may be long
                key_, x, y = (b.column(c).slice(k, 1) for c in range(3))
                rows = made(edit_script((x[0].as_py() or "").split("\n"), (y[0].as_py() or "").split("\n")))
                n = len(rows[0])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(key_.to_pylist() * n, key_.type), *[pa.array(r) for r in rows]], names=[key, *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return pairs.select(key, "old", "new").mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, {schema}")


def line_diff(pairs: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, old, new) texts to counts of added and removed lines and hunks."""
    n = lambda s, c: sum(k == c for k, _ in s)
    return _scripts(pairs, key, lambda s: ([n(s, "+")], [n(s, "-")], [len(hunks(s, context))]), "added long, removed long, hunks long")


def hunk_lines(pairs: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, old_start, new_start, ord, op, line): the lines of each hunk of (key, old, new)
    texts, those around the changes included; starts are line numbers from 1."""

    def made(script: list) -> tuple:
        out, at_old, at_new, o, m = [], [], [], 1, 1
        for c, _ in script:
            at_old.append(o)
            at_new.append(m)
            o, m = o + (c != "+"), m + (c != "-")
        for h, (x, y) in enumerate(hunks(script, context)):
            out += [(h, at_old[x], at_new[x], k - x, *script[k]) for k in range(x, y)]
        return tuple(map(list, zip(*out))) if out else ([],) * 6

    return _scripts(pairs, key, made, "hunk long, old_start long, new_start long, ord long, op string, line string")


def table_hash(df: DataFrame, name: str) -> DataFrame:
    """One order-insensitive hash of a table's rows, each value with its length before it (a null is
    a dash), so that neither separators nor nulls are mistaken: the hash of the sums of four 60-bit
    pieces of the rows' hashes, which partitions add up on their own."""
    value = lambda c: F.col(f"`{c}`").cast("string")
    row = F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in df.columns])
    h = df.select(F.sha2(row.cast("binary"), 256).alias("h"))
    piece = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = [F.coalesce(piece(i), F.lit("0")) for i in range(4)]
    return h.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *sums).cast("binary"), 256).alias("content_hash")).select(F.lit(name).alias("tbl"), "n_rows", "content_hash")


def all_tables(diffs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, diffs)
