"""Connected components of an edge table, for links between documents or fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_stored, stored


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has long columns a and b. Each round is a large-star and a small-star step
    (joins with one minimum a node, summed before the shuffle); they end, after about the
    logarithm of the longest chain, in one star a component. No group is ever gathered.
    """
    pair = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = stored(edges.select(*pair(F.col("a"), F.col("b"))).filter("u <> v").distinct())
    said = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(least, "v").select(F.col("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(*pair(F.col("v"), F.col("m"))).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = stored(small)
        now = new.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(e)
        e = new
        if now == said:
            break
        said = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
