"""Tables in a folder that are replaced or extended without a reader ever losing them.

A replaced table is a folder of versions (``v=00000007``); the highest complete one counts. An
appended table is a folder of generations, of which the highest complete one counts; parts are
added to it. Writers of one table are not coordinated: the driver is its only writer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def _at(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v={version:08d}"


def latest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table's newest version, an empty one where there is none. A version that cannot be
    read fails; only absence is no error."""
    there = _versions(spark, path)
    return spark.read.schema(schema).parquet(_at(path, there[-1])) if there else spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, keep: int = 2) -> None:
    """A new version of the table; of the older ones ``keep`` - 1 stay, for readers that have
    begun."""
    spark = df.sparkSession
    there = _versions(spark, path)
    df.write.mode("overwrite").parquet(_at(path, (there or [0])[-1] + 1))
    for old in there[: max(0, len(there) + 1 - keep)]:
        fs, p = _fs(spark, _at(path, old))
        fs.delete(p, True)


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows appended so far."""
    return latest(spark, path, schema)


def append(df: DataFrame, path: str, by: str) -> None:
    """Adds rows to the table, a folder for each value of ``by``."""
    there = _versions(df.sparkSession, path)
    df.write.mode("append").partitionBy(by).parquet(_at(path, (there or [1])[-1]))


def replace(df: DataFrame, path: str, by: str) -> None:
    """A new generation of an appended table."""
    spark = df.sparkSession
    there = _versions(spark, path)
    df.write.mode("overwrite").partitionBy(by).parquet(_at(path, (there or [0])[-1] + 1))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (path, content) as files below a folder that all executors share; a path that
    leaves the folder fails. Each task writes its own rows."""

    def run(batches: Iterator) -> Iterator:
        import posixpath

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = posixpath.normpath(posixpath.join(root, path))
                if not at.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{path} leaves the folder")
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at) as out:
                    out.write((content or "").encode())
            yield b.slice(0, 0).select(["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
