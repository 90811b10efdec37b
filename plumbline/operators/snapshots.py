"""Versioned snapshots of generated files: manifests, provenance, tags, and a store of objects.

A snapshot is a row of ``index`` (SNAPSHOT), rows of ``manifests`` (snapshot_id, ord, path,
content_hash, size) and rows of ``stages``; contents are kept once under their hash. All of them
are tables; a store is a folder of such tables, each in versions (``sources.versions``), so a
reader never meets a half-written one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from plumbline.functions.scalars import sha256
from plumbline.sources import versions

from . import diff
from .fingerprint import new_objects

SNAPSHOT = "id string, parent_id string, tag string, description string, created_at timestamp, source_lang string, target_lang string, input_path string, content_hash string, score double, status string, file_count long, calls long, tokens long, duration_ms long"
MANIFEST = "snapshot_id string, ord long, path string, content_hash string, size long"
STAGES = "snapshot_id string, ord long, name string, status string, score double, duration_ms long, calls long, prompt_tokens long, completion_tokens long, errors long"
OBJECTS = "hash string, prefix string, content string"
SUMMARY = ("id", "parent_id", "tag", "created_at", "source_lang", "target_lang", "score", "status", "file_count")


def manifest(files: DataFrame, snapshot: Column) -> DataFrame:
    """Manifest rows of files (ord, path, content); ``size`` counts bytes."""
    content = F.coalesce("content", F.lit(""))
    return files.select(snapshot.alias("snapshot_id"), F.col("ord").cast("long").alias("ord"), "path", sha256(content).alias("content_hash"), F.octet_length(content).cast("long").alias("size"))


def manifest_hash(manifests: DataFrame) -> DataFrame:
    """(snapshot_id, content_hash, file_count): the hash of all paths and hashes in file order.
    The hash runs over one string, so a snapshot's paths and hashes (not its files) meet in one
    task."""
    entry = F.struct("ord", F.concat("path", "content_hash").alias("e"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "")
    return manifests.groupBy("snapshot_id").agg(sha256(whole).alias("content_hash"), F.count("*").alias("file_count"))


def snapshot_id(created_at: Column, content_hash: Column) -> Column:
    """The first 16 hex digits of the hash of the time in nanoseconds and the content's hash."""
    said = F.concat(F.lit('{"t":'), (F.unix_micros(created_at) * 1000).cast("string"), F.lit(',"c":"'), content_hash, F.lit('"}'))
    return F.substr(sha256(said), F.lit(1), F.lit(16))


def provenance(stages: DataFrame) -> DataFrame:
    """(snapshot_id, calls, tokens, duration_ms, score): sums over the stages; the score is the
    best of a stage, 0 at least."""
    return stages.groupBy("snapshot_id").agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("score"),
    )


def summaries(index: DataFrame) -> DataFrame:
    """The summary columns, newest first (equal times by id)."""
    return index.select(*SUMMARY).orderBy(F.desc("created_at"), "id")


def by_tag(index: DataFrame, tag: str) -> DataFrame:
    """The first snapshot that has the tag: the oldest, by id among equals."""
    return index.filter(F.col("tag") == tag).orderBy("created_at", "id").limit(1)


def tagged(index: DataFrame, snapshot: str, tag: str) -> DataFrame:
    return index.withColumn("tag", F.when(F.col("id") == snapshot, F.lit(tag)).otherwise(F.col("tag")))


def without(index: DataFrame, snapshot: str, key: str = "id") -> DataFrame:
    return index.filter(~F.col(key).eqNullSafe(F.lit(snapshot)))


def contents(manifests: DataFrame, objects: DataFrame) -> DataFrame:
    """(snapshot_id, ord, path, content) of manifest rows; fails for an object that is absent."""
    j = manifests.join(objects.select(F.col("hash").alias("content_hash"), "content"), "content_hash", "left")
    there = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("object is absent: "), "content_hash"))).otherwise(F.col("content"))
    return j.select("snapshot_id", "ord", "path", there.alias("content"))


def orphans(objects: DataFrame, manifests: DataFrame) -> DataFrame:
    """Objects that no manifest names."""
    return objects.join(manifests.select(F.col("content_hash").alias("hash")).distinct(), "hash", "left_anti")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, renamed_from) of two manifests, by path in order. A path that was added
    with the content of a removed one is ``renamed`` (the first such by path)."""
    o = old.select("path", F.col("content_hash").alias("was"))
    n = new.select("path", F.col("content_hash").alias("now"))
    j = o.join(n, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    changes = j.select("path", "was", "now", kind.alias("change")).filter("change is not null")
    nth = lambda c: F.row_number().over(W.partitionBy(c).orderBy("path"))
    gone = changes.filter("change = 'removed'").select(F.col("was").alias("now"), F.col("path").alias("renamed_from"), nth("was").alias("_n"))
    came = changes.filter("change = 'added'").withColumn("_n", nth("now")).join(gone, ["now", "_n"], "left")
    moved = came.select("path", F.when(F.col("renamed_from").isNull(), "added").otherwise("renamed").alias("change"), "renamed_from")
    left = came.filter("renamed_from is not null").select(F.col("renamed_from").alias("path"))
    rest = changes.filter("change <> 'added'").select("path", "change", F.lit(None).cast("string").alias("renamed_from")).join(left, "path", "left_anti")
    return moved.unionByName(rest)


class Store:
    """A folder of snapshot tables. Each change writes a new version of the tables it touches."""

    TABLES = {"index": SNAPSHOT, "manifests": MANIFEST, "stages": STAGES}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return versions.latest(self.spark, f"{self.root}/{name}", self.TABLES[name])

    def objects(self) -> DataFrame:
        return versions.appended(self.spark, f"{self.root}/objects", OBJECTS)

    def save(self, snapshot: DataFrame, files: DataFrame, stages: DataFrame) -> str:
        """Adds a snapshot: one row of description (created_at, source_lang, ...), its files (ord,
        path, content) and its stages. Objects that are there already are not written again."""
        files = files.withColumn("content", F.coalesce("content", F.lit("")))
        versions.append(new_objects(files, self.objects()), f"{self.root}/objects", "prefix")
        described = snapshot.first().asDict()
        rows = manifest(files, F.lit(""))
        found = manifest_hash(rows).first()
        totals = (found["content_hash"], found["file_count"]) if found else (self.spark.range(1).select(sha256(F.lit("")).alias("h")).first()["h"], 0)
        sums = provenance(stages.withColumn("snapshot_id", F.lit(""))).first()
        one = self.spark.createDataFrame([described], snapshot.schema).withColumn("content_hash", F.lit(totals[0]))
        key = one.select(snapshot_id(F.col("created_at"), F.col("content_hash")).alias("id")).first()["id"]
        made = {"id": F.lit(key), "file_count": F.lit(totals[1]), **{c: F.lit(sums[c] if sums else 0) for c in ("calls", "tokens", "duration_ms", "score")}}
        index = self.table("index")
        one = one.withColumns(made)
        row = one.select(*[(F.col(f.name) if f.name in one.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in index.schema.fields])
        self._write("manifests", without(self.table("manifests"), key, "snapshot_id").unionByName(rows.withColumn("snapshot_id", F.lit(key))))
        self._write("stages", without(self.table("stages"), key, "snapshot_id").unionByName(stages.withColumn("snapshot_id", F.lit(key)).select(*self.table("stages").columns)))
        self._write("index", without(index, key).unionByName(row))
        return key

    def _write(self, name: str, df: DataFrame) -> None:
        versions.write(df, f"{self.root}/{name}")

    def load(self, snapshot: str) -> DataFrame:
        """The snapshot's row; fails where there is none."""
        row = self.table("index").filter(F.col("id") == snapshot)
        if row.isEmpty():
            raise KeyError(f"no snapshot {snapshot}")
        return row

    def files(self, snapshot: str) -> DataFrame:
        return contents(self.table("manifests").filter(F.col("snapshot_id") == snapshot), self.objects())

    def tag(self, snapshot: str, tag: str) -> None:
        self.load(snapshot)
        self._write("index", tagged(self.table("index"), snapshot, tag))

    def find(self, tag: str) -> DataFrame:
        return by_tag(self.table("index"), tag)

    def delete(self, snapshot: str, objects: bool = False) -> None:
        """Drops a snapshot's rows; with ``objects`` also the contents that no other one names."""
        self._write("index", without(self.table("index"), snapshot))
        for name in ("manifests", "stages"):
            self._write(name, without(self.table(name), snapshot, "snapshot_id"))
        if objects:
            versions.replace(self.objects().join(orphans(self.objects(), self.table("manifests")).select("hash"), "hash", "left_anti"), f"{self.root}/objects", "prefix")

    def diff(self, old: str, new: str) -> dict[str, DataFrame]:
        """What changed between two snapshots: ``files`` (path, change, renamed_from, lines_added,
        lines_removed) in order of path, ``stages`` (deltas, old and new status), and ``summary``
        (one row: score_delta, files by change, sums of lines). Whole files that were added or
        removed count all their lines; renamed ones none."""
        m, s, i = self.table("manifests"), self.table("stages"), self.table("index")
        of = lambda df, k: df.filter(F.col("snapshot_id") == k)
        changes = compared(of(m, old), of(m, new))
        text = lambda k, name: self.files(k).select("path", F.col("content").alias(name))
        pairs = changes.filter("change = 'modified'").join(text(old, "old"), "path").join(text(new, "new"), "path")
        lines = diff.line_diff(pairs, "path").select("path", F.col("added").alias("lines_added"), F.col("removed").alias("lines_removed"))
        zero = F.lit(0).cast("long")
        came = changes.filter("change = 'added'").join(text(new, "t"), "path").select("path", diff.line_counts(F.col("t")).cast("long").alias("lines_added"), zero.alias("lines_removed"))
        gone = changes.filter("change = 'removed'").join(text(old, "t"), "path").select("path", zero.alias("lines_added"), diff.line_counts(F.col("t")).cast("long").alias("lines_removed"))
        lines = lines.unionByName(came).unionByName(gone)
        files = changes.join(lines, "path", "left").select("path", "change", "renamed_from", F.coalesce("lines_added", zero).alias("lines_added"), F.coalesce("lines_removed", zero).alias("lines_removed"))
        score = lambda k: i.filter(F.col("id") == k).select(F.lit(1).alias("_k"), F.col("score").alias(f"_{k}"))
        delta = score(old).join(score(new), "_k").select("_k", (F.col(f"_{new}") - F.col(f"_{old}")).alias("score_delta"))
        total = diff.files_summary(changes, lines).withColumn("_k", F.lit(1))
        stages = diff.stage_delta(of(s, old), of(s, new), "name", ["score", "calls", "duration_ms"], "status")
        return {"files": diff.in_order(files), "stages": stages, "summary": delta.join(total, "_k").drop("_k")}

    def restore(self, snapshot: str, folder: str) -> None:
        """Writes the snapshot's files below a folder that the executors share."""
        versions.write_files(self.files(snapshot), folder)
