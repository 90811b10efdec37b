"""Windows that hold when one key has a third of all rows.

Rows are dealt to stretches of their order (an hour, a range of ids): a window runs inside each
(key, stretch), and what the stretches before have added up to comes from one row a stretch. So a
key's rows are spread over tasks, and only its stretches meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hour(at: str) -> Column:
    """A stretch of an hour of event time."""
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 3_600_000_000).cast("long")


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs])


def running(df: DataFrame, key: str, order: list[str], stretch: Column, totals: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Adds running totals over the rows of a key in order, the row itself included (or with
    ``before`` only those before it): name -> ("sum" or "max", value). A sum of nothing is 0, a
    maximum null. ``stretch`` must not fall as the order rises."""
    at = df.withColumns({"_s": stretch, **{f"_v{i}": v for i, (_, v) in enumerate(totals.values())}})
    kinds = {n: (k, f"_v{i}", f"_c{i}") for i, (n, (k, _)) in enumerate(totals.items())}
    agg = {"sum": F.sum, "max": F.max}
    ends = at.groupBy(key, "_s").agg(*[agg[k](v).alias(c) for k, v, c in kinds.values()])
    past = W.partitionBy(key).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), *[agg[k](c).over(past).alias(c) for k, _, c in kinds.values()])
    inside = W.partitionBy(key, "_s").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    near = at.withColumns({f"_n{i}": agg[k](v).over(inside) for i, (k, v, _) in enumerate(kinds.values())})
    j = near.join(carry, _same(near, carry, [(key, "_k"), ("_s", "_t")]), "left")
    out = []
    for i, (n, (k, _, c)) in enumerate(kinds.items()):
        made = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_n{i}"), F.lit(0)) if k == "sum" else F.greatest(c, f"_n{i}")
        out.append(made.alias(n))
    return j.select(*df.columns, *out)


def ranked(df: DataFrame, key: str, order: list[str], stretch: Column, name: str) -> DataFrame:
    """Adds the row's number within its key, from 1."""
    return running(df, key, order, stretch, {name: ("sum", F.lit(1).cast("long"))})


def lagged(df: DataFrame, key: str, order: list[str], stretch: Column, value: str, name: str) -> DataFrame:
    """Adds ``value`` of the row before within the key, null for the first."""
    at = df.withColumn("_s", stretch)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    ends = at.groupBy(key, "_s").agg(last.alias("_end"))
    carry = ends.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.lag("_end").over(W.partitionBy(key).orderBy("_s")).alias("_carry"))
    near = at.withColumn("_near", F.lag(F.struct(F.col(value).alias("v"))).over(W.partitionBy(key, "_s").orderBy(*order)))
    j = near.join(carry, _same(near, carry, [(key, "_k"), ("_s", "_t")]), "left")
    return j.select(*df.columns, F.coalesce("_near", "_carry")["v"].alias(name))


def previous(df: DataFrame, key: str, order: str, name: str, width: int = 100_000) -> DataFrame:
    """Adds the ``order`` of the row before within the key, as ``lag`` over a distinct integer
    ``order`` would."""
    return lagged(df, key, [order], F.floor(F.col(order) / width).cast("long"), order, name)
