"""Streams run until their source is read; what each batch gives out is kept as rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(made: DataFrame, root: str, mode: str, partitions: int | None = None) -> StreamingQuery:
    """Runs a stream over all that its source holds now and writes each batch below
    ``root/rows``; a batch that is run again replaces its own rows, so none is given out twice. A
    later run with the same root goes on behind the last batch. State lies on the disks of the
    executors (RocksDB) and in the checkpoint below ``root``, in ``partitions`` parts (one a core
    at first), a number that a checkpoint keeps for good."""
    spark = made.sparkSession
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
    parts = str(partitions or spark.sparkContext.defaultParallelism)
    with _settings(spark, {STATE_STORE: ROCKS, "spark.sql.shuffle.partitions": parts}):
        q = made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def given(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows that ``run`` has given out so far; none where no batch has run."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows/batch=*").drop("batch")
