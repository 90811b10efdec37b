"""Metrics from observation rows: counters, gauges, histograms, recorders, and their exposition.

Observations are rows (kind, seconds, ok, tokens, score, at, tie); a register is an aggregate over
them, so no state is held. Bucket counts are cumulative once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The default bounds of a histogram, in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def number_text(value: Column) -> Column:
    """A whole number without a point, others cut (not rounded) to six digits after it, without
    zeros at the end; below 0 with a minus sign, ``NaN``, ``+Inf`` and ``-Inf`` as such."""
    v = value.cast("double")
    micros = F.floor(F.abs(v).cast("decimal(38,9)") * 1_000_000).cast("decimal(38,0)")
    whole, part = F.floor(micros / F.lit(1_000_000).cast("decimal(38,0)")), micros % 1_000_000
    digits = F.regexp_replace(F.lpad(part.cast("long").cast("string"), 6, "0"), "0+$", "")
    sign = F.when((v < 0) & (micros > 0), "-").otherwise("")
    body = F.concat(sign, whole.cast("string"), F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)))
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").otherwise(body)


def score_text(value: Column) -> Column:
    """A score cut to two digits."""
    return F.format_string("%.2f", F.floor(value * 100) / 100)


def labels_text(labels: Column) -> Column:
    """{name="value",...} of a map, by name; nothing for an empty or null one."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def histogram(df: DataFrame, value: str, by: list[str], bounds: tuple = BOUNDS) -> DataFrame:
    """(by, sum, count, buckets): buckets is array<struct<le, n>>, n the values at or below."""
    v = F.col(value)
    counts = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(v <= b).alias("n")) for b in bounds])
    return df.groupBy(*by).agg(F.coalesce(F.sum(v), F.lit(0.0)).cast("double").alias("sum"), F.count(v).alias("count"), counts.alias("buckets"))


def recorded(observations: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, errors, tokens, seconds, score): what a recorder of one kind of events counts:
    all, failed ones, tokens, time, and the last score."""
    return observations.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("errors"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        F.max_by("score", F.struct("at", "tie")).alias("score"),
    )


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines (name, ord, line) of metrics (name, kind, help, labels, value, buckets, sum, count):
    HELP and TYPE, then the value, or a histogram's buckets, sum and count. ``kind`` is
    counter, gauge or histogram."""
    labelled = labels_text(F.col("labels"))
    with_le = lambda le: labels_text(F.map_concat(F.coalesce("labels", F.create_map().cast("map<string,string>")), F.create_map(F.lit("le"), le)))
    bucket = lambda le, n: F.concat("name", F.lit("_bucket"), with_le(le), F.lit(" "), n.cast("string"))
    buckets = F.concat(
        F.transform("buckets", lambda b: bucket(number_text(b["le"]), b["n"])),
        F.array(bucket(F.lit("+Inf"), F.col("count")), F.concat("name", F.lit("_sum"), labelled, F.lit(" "), number_text(F.col("sum"))), F.concat("name", F.lit("_count"), labelled, F.lit(" "), F.col("count").cast("string"))),
    )
    value = F.array(F.concat("name", labelled, F.lit(" "), number_text(F.col("value"))))
    head = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))
    lines = F.concat(head, F.when(F.col("kind") == "histogram", buckets).otherwise(value))
    return metrics.select("name", F.posexplode(lines).alias("ord", "line"))
