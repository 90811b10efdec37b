"""Content and dependency fingerprints, change classes, result cache and object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import sha256


def fingerprints(files: DataFrame, deps: DataFrame) -> DataFrame:
    """(path, file_hash, composite_hash): the hash of a file's own and its known direct
    dependencies' hashes, these sorted; unknown dependencies count for nothing."""
    own = files.select("path", sha256(F.col("content")).alias("file_hash"))
    found = deps.join(own.select(F.col("path").alias("dep_path"), F.col("file_hash").alias("_dep")), "dep_path")
    by = found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("_dep")), "|").alias("_deps"))
    return own.join(by, "path", "left").select("path", "file_hash", sha256(F.concat_ws("|", "file_hash", "_deps")).alias("composite_hash"))


def classify(current: DataFrame, previous: DataFrame | None, force: bool = False) -> DataFrame:
    """(path, class): new, changed, unchanged or deleted; without a state all are new."""
    if previous is None:
        return current.select("path", F.lit("new").alias("class"))
    j = current.select("path", F.col("composite_hash").alias("now")).join(previous.select("path", F.col("composite_hash").alias("was")), "path", "full_outer")
    same = F.lit(False) if force else F.col("now") == F.col("was")
    return j.select("path", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("class"))


def needed(files: DataFrame, classes: DataFrame) -> DataFrame:
    return files.join(classes.filter(F.col("class").isin("new", "changed")), "path", "left_semi")


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.select("path", "composite_hash").join(cache, ["path", "composite_hash"])


def cache_prune(cache: DataFrame, current: DataFrame) -> DataFrame:
    return cache.join(current.select("path").distinct(), "path", "left_anti")


def new_objects(content: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Content-addressed objects that the store lacks: hash, prefix, content."""
    rows = content.select(sha256(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
    rows = rows if stored is None else rows.join(stored.select("hash"), "hash", "left_anti")
    return rows.select("hash", F.left("hash", F.lit(2)).alias("prefix"), "content")
