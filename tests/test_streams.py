"""The stateful processor against the batch folds, the stream join against the table join."""

import json
import random

from pyspark.sql import functions as F

from plumbline.operators import telemetry
from plumbline.streaming import outputs, recordings, run_processor

EVENTS = "run string, kind string, stage string, at timestamp, seq long, value long"
KINDS = ["migration.started", "migration.completed", "migration.failed", "stage.started", "stage.completed", "stage.failed", "log", None]
DAY = 86_400_000_000


def events(seed=3, runs=6, n=160):
    rnd = random.Random(seed)
    rows = [(f"r{rnd.randrange(runs)}", rnd.choice(KINDS), rnd.choice(["parse", "build", None]), DAY + rnd.randrange(40) * 1_000_000, i, i * 7) for i in range(n)]
    return rows + [(None, "log", None, 0, 900, 0), ("r0", "log", None, None, 901, 0)]


def table(spark, rows):
    return spark.createDataFrame(rows, "run string, kind string, stage string, us long, seq long, value long").select("run", "kind", "stage", F.timestamp_micros("us").alias("at"), "seq", "value")


def test_runs_in_any_order_equal_the_batch_fold_and_leave_no_state(spark, tmp_path):
    rows = events()
    random.Random(5).shuffle(rows)
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    table(spark, []).write.parquet(src)
    stream = run_processor.records(spark.readStream.schema(EVENTS).parquet(src), "2 minutes", 60_000_000)
    for i in range(3):  # one batch after another, each goes on from the checkpoint
        table(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(src)
        q = outputs.run(stream, root, "update", 2)
    got = {r["run"]: r for r in run_processor.last(outputs.given(spark, root, run_processor.OUTPUT)).collect()}
    whole = table(spark, rows).filter("run is not null and at is not null")
    assert {r["run"]: r["n_events"] for r in whole.groupBy("run").agg(F.count("*").alias("n_events")).collect()} == {k: r["n_events"] for k, r in got.items()}
    want = telemetry.run_records(whole, "run", "kind", "at", "seq", ["value"]).select("run", "status", F.unix_micros("started").alias("s"), F.unix_micros("ended").alias("e"), "value").collect()
    assert {tuple(r) for r in want} == {(r["run"], r["status"], r["started"], r["ended"], r["value"]) for r in got.values() if r["status"]}
    stages = telemetry.stage_states(whole.filter("stage is not null"), ["run", "stage"], "kind", "at", "seq").select("run", "stage", "status", "n_starts", "millis").collect()
    assert {tuple(r) for r in stages} == {(k, s["stage"], s["status"], s["n_starts"], s["millis"]) for k, r in got.items() for s in r["stages"]}
    assert not any(r["closed"] for r in got.values())
    # an event far behind all others: the timers of the rest fire, and their state is gone
    table(spark, [("z", "log", None, 5 * DAY, 1, 0)]).coalesce(1).write.mode("append").parquet(src)
    q = outputs.run(stream, root, "update", 2)
    after = {r["run"]: r for r in run_processor.last(outputs.given(spark, root, run_processor.OUTPUT)).collect()}
    assert {k for k, r in after.items() if r["closed"]} == set(got)
    assert all(after[k].asDict() | {"closed": False} == r.asDict() for k, r in got.items())
    # what is left: the newest run's value and its timer
    metrics = [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert metrics["customMetrics"]["numRegisteredTimers"] + metrics["numRowsTotal"] <= 4
    # a late event of a freed run opens none again
    table(spark, [("r0", "migration.failed", None, DAY + 10_000_000, 999, 1)]).coalesce(1).write.mode("append").parquet(src)
    outputs.run(stream, root, "update", 2)
    assert {r["run"]: r for r in run_processor.last(outputs.given(spark, root, run_processor.OUTPUT)).collect()} == after


def test_nothing_given_out_is_an_empty_table(spark, tmp_path):
    assert outputs.given(spark, str(tmp_path / "none"), run_processor.OUTPUT).count() == 0


def write_lines(folder, name, rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def request(i, at, body=None):
    return {"id": i, "session": "s", "at": at * 1_000_000, "method": "GET", "path": f"/{i}", "header": {"A": "b"}, "body": body}


def response(i, at, body=None):
    return {"id": i, "at": at * 1_000_000, "status": 200, "header": {"X": ["1", "2"], "Y": []}, "body": body}


def test_pairs_of_streams_equal_pairs_of_tables(spark, tmp_path):
    q, r, root = tmp_path / "q", tmp_path / "r", str(tmp_path / "out")
    schema = recordings.exchanges(spark.createDataFrame([], recordings.REQUEST).withColumn("at", F.timestamp_micros("at")), spark.createDataFrame([], recordings.RESPONSE).withColumn("at", F.timestamp_micros("at")), "1 minute", "30 seconds").schema
    q.mkdir()
    r.mkdir()
    stream = recordings.exchanges(recordings.lines(spark, str(q), recordings.REQUEST), recordings.lines(spark, str(r), recordings.RESPONSE), "1 minute", "30 seconds")
    # answered, late answer, answer before the request, none, two answers, the same instant, no record
    write_lines(q, "1.json", [request("a", 10, "{\"k\": 1}"), request("b", 11, "no \"json\""), request("c", 12), request("d", 13, ""), "no record", request(None, 5)])
    write_lines(r, "1.json", [response("a", 15, "[1]"), response("b", 60), response("c", 11), response(None, 9)])
    outputs.run(stream, root, "append", 2)
    first = {p["id"] for p in recordings.without_marks(outputs.given(spark, root, schema)).collect()}
    assert first == {"a"}  # no interval has passed
    write_lines(q, "2.json", [request("e", 40, "x"), request("f", 50)])
    write_lines(r, "2.json", [response("e", 45), response("e", 70), response("f", 50, "y\n"), response("g", 50)])
    outputs.run(stream, root, "append", 2)
    write_lines(q, "3.json", [request("", 1000)])
    write_lines(r, "3.json", [response("", 1100)])
    q3 = outputs.run(stream, root, "append", 2)
    got = recordings.without_marks(outputs.given(spark, root, schema)).collect()
    of = lambda folder, s: spark.read.schema(s).json(str(folder)).withColumn("at", F.timestamp_micros("at"))
    want = recordings.without_marks(recordings.exchanges(of(q, recordings.REQUEST), of(r, recordings.RESPONSE), "1 minute", "30 seconds")).collect()
    key = lambda p: (p["id"], str(p["answered_at"]))
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 7
    by = {p["id"]: p for p in got}
    assert [i for i in "abcdef" if by[i]["answered_at"] is None] == ["b", "c", "d"]
    assert by["a"]["expected_header"] == {"X": "1"} and by["a"]["body"] == "{\"k\": 1}" and by["a"]["expected_body"] == "[1]"
    assert json.loads(by["b"]["body"]) == "no \"json\"" and by["d"]["body"] is None and json.loads(by["f"]["expected_body"]) == "y\n"
    left = [p for p in q3.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert left["numRowsTotal"] <= 4  # the marks alone
