"""Event streams folded to run states; the batch fold gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators import storage
from plumbline.sources import versions


def states(events: DataFrame, key: str, status: Column, order: list[str]) -> DataFrame:
    """Works on a stream (complete or update mode) and on a table alike."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))


def minute_counts(events: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling minutes behind a watermark (an extra of this engine)."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 minute")).count()


def recent_states(events: DataFrame, key: str, status: Column, order: list[str], at: str, keep: str) -> DataFrame:
    """States a window of ``keep``; the stream forgets a window once the watermark has passed it,
    so that its state is bounded by the keys of the latest windows."""
    fold = F.max_by(status, F.struct(*order)).alias("status")
    return events.withWatermark(at, keep).groupBy(F.window(at, keep).alias("w"), key).agg(fold, F.count("*").alias("n_events")).select(F.col("w.start").alias("since"), key, "status", "n_events")


def _source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(spark: SparkSession, path: str, schema, fold: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Runs a fold over all files of a folder as a stream until none is left. Each batch's result
    becomes a version of a table in the shared folder; nothing is held by the driver."""
    root = storage.scratch(spark)
    made = fold(_source(spark, path, schema))
    write = lambda df, _: versions.write(df, f"{root}/{name}")
    made.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return versions.latest(spark, f"{root}/{name}", made.schema)


def publish(spark: SparkSession, path: str, schema, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Hands every new batch of events to every subscriber once, in order of batches; a later run
    with the same checkpoint goes on behind the last batch."""

    def hand_out(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for s in subscribers:
                s(df, batch)
        finally:
            df.unpersist()

    _source(spark, path, schema).writeStream.foreachBatch(hand_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
