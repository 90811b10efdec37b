"""Queries that run the event table as a stream: a stateful processor and a join of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import storage
from plumbline.streaming import outputs, recordings, run_processor

from .catalogue import cents, micros
from .registry import query, read

KIND = "CASE event_type WHEN 'signup' THEN 'migration.started' WHEN 'purchase' THEN 'migration.completed' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'migration.failed' ELSE 'stage.failed' END WHEN 'click' THEN 'stage.started' ELSE CASE WHEN event_id % 4 = 0 THEN 'log' ELSE 'stage.completed' END END"


@query(f"""WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run, epoch_us(ts) AS us, epoch_us(ts)::HUGEINT * 1000000000 + event_id AS o, {KIND} AS kind, 's' || event_id % 3 AS stage, CAST(floor(value * 100) AS BIGINT) AS value FROM events),
 r AS (SELECT run, count(*) AS n_events, count(*) FILTER (kind = 'migration.started') > 0 AS begun, arg_max(kind, o) FILTER (kind IN ('migration.completed', 'migration.failed')) AS k, arg_max(value, o) FILTER (kind IN ('migration.completed', 'migration.failed')) AS value FROM e GROUP BY run),
 g AS (SELECT run, stage, count(*) FILTER (kind = 'stage.started') AS n, arg_min(us, o) FILTER (kind = 'stage.started') AS a, arg_max(us, o) FILTER (kind <> 'stage.started') AS b, arg_max(kind, o) FILTER (kind <> 'stage.started') AS k FROM e WHERE kind LIKE 'stage.%' GROUP BY run, stage),
 t AS (SELECT run, string_agg(stage || ' ' || CASE k WHEN 'stage.completed' THEN 'completed' WHEN 'stage.failed' THEN 'failed' ELSE 'running' END || ' ' || n || coalesce(' ' || CAST(floor((b - a) / 1000) AS BIGINT), ''), ',' ORDER BY stage) AS stages FROM g WHERE n > 0 GROUP BY run)
 SELECT run, n_events, CASE WHEN NOT begun THEN NULL WHEN k IS NULL THEN 'running' ELSE split_part(k, '.', 2) END AS status, value, coalesce(stages, '') AS stages FROM r LEFT JOIN t USING (run)""")
def stream_run_records(spark, d):
    # a run is a user's day: its state goes when a day has passed without an event
    e = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    run = F.concat_ws(":", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd"))
    e = e.select(run.alias("run"), F.expr(KIND).alias("kind"), F.expr("'s' || event_id % 3").alias("stage"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), cents("value").cast("long").alias("value"))
    root = storage.scratch(spark)
    outputs.run(run_processor.records(e, "1 hour", 86_400_000_000), root, "update")
    r = run_processor.last(outputs.given(spark, root, run_processor.OUTPUT))
    text = F.transform("stages", lambda s: F.concat_ws(" ", s["stage"], s["status"], s["n_starts"], s["millis"]))
    return r.select("run", "n_events", "status", "value", F.concat_ws(",", text).alias("stages"))


@query("""WITH q AS (SELECT event_id AS id, epoch_us(ts) AS us, '/' || event_type AS path, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '"say \\"' || user_id || '\\""' END AS body FROM events WHERE event_type <> 'error'),
 r AS (SELECT event_id AS id, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 10000 + x.n * 5000000 AS us, 200 + x.n AS status, CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ']' ELSE '"ok"' END AS answer FROM events, (VALUES (0), (1)) AS x(n) WHERE event_id % 7 <> 0 AND (x.n = 0 OR event_id % 10 = 0))
 SELECT CAST(q.id AS VARCHAR) AS id, path, body, CAST(status AS BIGINT) AS status, r.us - q.us AS waited, CASE WHEN r.id IS NOT NULL THEN path END AS header, answer FROM q LEFT JOIN r ON q.id = r.id AND r.us BETWEEN q.us AND q.us + 100000000""")
def stream_exchanges(spark, d):
    e = read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    i, path = F.col("event_id"), F.concat(F.lit("/"), "event_type")
    root = storage.scratch(spark)
    said = F.concat(F.lit('say "'), "user_id", F.lit('"'))
    q = e.filter("event_type <> 'error'").select(i.cast("string").alias("id"), F.col("user_id").cast("string").alias("session"), F.col("us").alias("at"), F.lit("GET").alias("method"), path.alias("path"), F.create_map(F.lit("A"), F.lit("b")).alias("header"), F.when(i % 4 == 0, F.col("props")).when(i % 4 == 1, said).when(i % 4 == 2, "").alias("body"))
    n = F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    r = e.filter(i % 7 != 0).select("*", n.alias("n")).select(i.cast("string").alias("id"), (F.col("us") + cents("value").cast("long") * 10_000 + F.col("n") * 5_000_000).alias("at"), (F.col("n") + 200).alias("status"), F.create_map(F.lit("Path"), F.array(path)).alias("header"), F.when(i % 2 == 0, F.concat(F.lit("["), i, F.lit("]"))).otherwise("ok").alias("body"))
    for part, name in ((q, "requests"), (r, "responses")):
        # the recorder's last line: its clock, a day on, so that all intervals pass
        mark = part.agg((F.max("at") + 86_400_000_000).alias("at")).filter("at is not null").withColumn("id", F.lit(""))
        part.unionByName(mark, allowMissingColumns=True).write.json(f"{root}/{name}")
    pairs = recordings.exchanges(recordings.lines(spark, f"{root}/requests", recordings.REQUEST), recordings.lines(spark, f"{root}/responses", recordings.RESPONSE), "5 minutes", "100 seconds")
    outputs.run(pairs, root, "append")
    out = recordings.without_marks(outputs.given(spark, root, pairs.schema))
    waited = micros("answered_at") - micros("at")
    return out.select("id", "path", "body", F.col("status").cast("long").alias("status"), waited.alias("waited"), F.col("expected_header")["Path"].alias("header"), F.col("expected_body").alias("answer"))
