"""Tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_own: list[str] = []
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). Where that is
    unset, a temporary folder of this process serves a local master; any other one fails, since
    its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="plumbline-kept-"))
        base = "file://" + _own[0]
    _made.append(f"{base.rstrip('/')}/plumbline-kept-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Deals rows by a hash of ``key`` to four tasks a core, whatever files they come from: for small
    rows of which much is made, since a small file is read by one task. The number is stated, so
    that adaptive execution does not put the small partitions together again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``kept`` that no later result reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all folders that this process made. Results that read them are gone then: write
    these first."""
    while _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a number to each of distinct values that rises in their order: ranges of values are
    sorted each on its own, and a range's numbers are above those of the ranges before. To be
    stored before it is used twice."""
    return df.repartitionByRange(column).sortWithinPartitions(column).withColumn(name, F.monotonically_increasing_id())
