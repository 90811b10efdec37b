"""Span tables: nested intervals of traces, their self time, and sampling by trace.

A span's self time is its own time less what its children cover, so that overlapping children do not
count twice: the children's intervals, cut to their parent's, are swept in order of their starts
with the latest end so far. Without overlaps a trace's self times sum to its root's time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.scalars import sampled


def self_times(spans: DataFrame) -> DataFrame:
    """(trace, span, parent, started, ended, total, own): ``own`` is the self time. Columns: trace,
    span, parent (null for a root), started, ended (numbers). A span that ends before it starts, or
    not at all, has no time; a parent that is not there covers nothing; children beyond their
    parent's ends count as far as they lie in it. The children of one span meet in one task."""
    rows = spans.select("trace", "span", "parent", "started", F.greatest("started", F.coalesce("ended", "started")).alias("ended"))
    outer = rows.select("trace", F.col("span").alias("parent"), F.col("started").alias("_a"), F.col("ended").alias("_b"))
    inside = rows.filter("parent is not null and parent <> span").join(outer, ["trace", "parent"])
    cut = inside.select("trace", "parent", F.greatest("started", "_a").alias("_s"), F.least("ended", "_b").alias("_e"), "span").filter("_e > _s")
    before = F.max("_e").over(W.partitionBy("trace", "parent").orderBy("_s", "_e", "span").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_e") - F.greatest("_s", F.coalesce(before, "_s")))
    covered = cut.withColumn("_new", new).groupBy("trace", F.col("parent").alias("span")).agg(F.sum("_new").alias("_covered"))
    total = F.col("ended") - F.col("started")
    j = rows.join(covered, ["trace", "span"], "left")
    return j.select("trace", "span", "parent", "started", "ended", total.alias("total"), (total - F.coalesce("_covered", F.lit(0))).alias("own"))


def kept_traces(spans: DataFrame, ratio: float, failed: Column | None = None) -> DataFrame:
    """The spans of a share of the traces, decided once a trace by a hash of its id; where ``failed``
    is given, traces with a failed span are all kept."""
    chosen = spans.filter(sampled(F.col("trace").cast("string"), ratio))
    if failed is None:
        return chosen
    bad = spans.filter(failed).select("trace").distinct()
    return spans.join(bad, "trace", "left_semi").unionByName(chosen.join(bad, "trace", "left_anti"))


def by_name(timed: DataFrame, names: DataFrame) -> DataFrame:
    """(name, n, total, own): the time of spans by their name, from ``self_times`` and (trace, span,
    name)."""
    return timed.join(names, ["trace", "span"]).groupBy("name").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("own").alias("own"))
