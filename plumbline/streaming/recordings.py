"""Recorded requests and responses, two streams of JSON lines, paired inside a time interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: One line a record; ``at`` in microseconds. An empty ``id`` is no request but a mark that its
#: recorder has come to ``at``, so that the watermark moves on without traffic.
REQUEST = "id string, session string, at long, method string, path string, header map<string,string>, body string"
RESPONSE = "id string, at long, status int, header map<string,array<string>>, body string"


def lines(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """The stream of records in a folder; a line that is no record is one without id and time,
    and goes."""
    r = spark.readStream.schema(schema)
    if files_a_batch:
        r = r.option("maxFilesPerTrigger", files_a_batch)
    return r.json(folder).withColumn("at", F.timestamp_micros("at"))


def as_json(body: Column) -> Column:
    """A body as JSON: itself where it is JSON, else a quoted string; null where it is empty."""
    quoted = F.to_json(F.struct(body.alias("b")))
    quoted = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    return F.when(F.length(body) > 0, F.when(F.try_parse_json(body).isNotNull(), body).otherwise(quoted))


def exchanges(requests: DataFrame, responses: DataFrame, late: str, wait: str) -> DataFrame:
    """Each request with each response of its id that comes no earlier than it and at most ``wait``
    later, or with none: of streams an unanswered request is given out once the watermark
    (``late`` behind the newest record of the slower stream) has passed its interval, and both sides forget
    what no record can meet any more. The same on tables. Records without an id or a time go.

    Columns: id, session, at, method, path, header, body; status, answered_at,
    expected_header (first values), expected_body; the last four null where unanswered."""
    q = requests.filter("id is not null and at is not null").withWatermark("at", late)
    r = responses.filter("id is not null and at is not null").select(F.col("id").alias("r_id"), F.col("at").alias("answered_at"), "status", F.col("header").alias("r_header"), F.col("body").alias("r_body")).withWatermark("answered_at", late)
    near = F.expr(f"id = r_id AND answered_at >= at AND answered_at <= at + INTERVAL {wait}")
    first = F.transform_values(F.map_filter("r_header", lambda _, v: F.size(v) > 0), lambda _, v: F.get(v, F.lit(0)))
    return q.join(r, near, "left_outer").select("id", "session", "at", "method", "path", "header", as_json(F.col("body")).alias("body"), "status", "answered_at", first.alias("expected_header"), as_json(F.col("r_body")).alias("expected_body"))


def without_marks(pairs: DataFrame) -> DataFrame:
    """To be taken of what the stream has given out: inside the stream the optimizer would move it before
    the watermark, which then would not see the marks."""
    return pairs.filter("id <> ''")
