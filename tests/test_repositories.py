"""Stores of graphs and vectors, and streams that are handed out."""

from plumbline.functions import scalars as S
from plumbline.operators import review
from plumbline.sources import io, repositories
from plumbline.streaming import run_state
from pyspark.sql import functions as F
import pytest


def test_graph_store(spark, tmp_path):
    g = repositories.GraphStore(spark, f"file://{tmp_path}/g")
    assert g.load().count() == 0
    m = lambda *rows: spark.createDataFrame(rows, "name string, path string, language string")
    f = lambda *rows: spark.createDataFrame(rows, "module string, function string")
    c = lambda *rows: spark.createDataFrame(rows, "caller string, callee string")
    g.store(modules=m(("A", "a.cbl", "cobol"), ("B", "b.cbl", "cobol")), functions=f(("A", "x"), ("A", "y"), ("B", "x")), calls=c(("x", "y"), ("x", "a")))
    g.store(modules=m(("A", "new.cbl", "cobol")), functions=f(("A", "y")), calls=c(("x", "y"), ("y", "x")))
    assert {r["name"]: (r["path"], r["functions"]) for r in g.load().collect()} == {"A": ("new.cbl", ["x", "y"]), "B": ("b.cbl", ["x"])}
    assert [r["callee"] for r in g.callees("x").collect()] == ["a", "y"] and g.table("calls").count() == 3


def test_vector_store(spark, tmp_path):
    v = repositories.VectorStore(spark, f"file://{tmp_path}/v")
    docs = lambda *rows: spark.createDataFrame(rows, v.SCHEMA)
    v.upsert(docs(("a", "A", [1.0, 0.0], {"k": "1"}), ("b", "B", [0.0, 1.0], None), ("z", "none", [0.0, 0.0], None), ("n", "null", None, None)))
    v.upsert(docs(("b", "B2", [0.6, 0.8], None)))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "q long, vector array<float>")
    got = sorted((r["q"], -r["score"], r["id"], r["text"]) for r in v.search(q, "q", 2).collect())
    assert got == [(1, -1.0, "a", "A"), (1, -0.6, "b", "B2"), (2, -0.8, "b", "B2"), (2, 0.0, "a", "A")]


def test_streams(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    df.write.parquet(src)
    take = lambda name: lambda rows, batch: seen.append((name, batch, sorted(r["id"] for r in rows.collect())))
    for _ in range(2):
        run_state.publish(spark, src, df.schema, [take("x"), take("y")], str(tmp_path / "cp"))
    assert seen == [("x", 0, [1, 2]), ("y", 0, [1, 2])]
    events = spark.sql("SELECT 1L AS k, 'a' AS s, timestamp '2024-01-01 00:00:10' AS ts UNION ALL SELECT 1, 'b', timestamp '2024-01-01 00:00:50' UNION ALL SELECT 1, 'c', timestamp '2024-01-01 00:02:00'")
    assert sorted((r["status"], r["n_events"]) for r in run_state.recent_states(events, "k", F.col("s"), ["ts"], "ts", "1 minute").collect()) == [("b", 2), ("c", 1)]


def test_reports(spark):
    items = spark.createDataFrame([("m", "f", 0.9, "approved"), ("m", "a", 0.1, "pending")], "module string, function string, score double, status string")
    assert review.report_document(items, "p").first()["report"] == '{"project":"p","total":2,"approved":1,"rejected":0,"regenerated":0,"pending":1,"items":[{"module":"m","function":"a","score":0.1,"status":"pending"},{"module":"m","function":"f","score":0.9,"status":"approved"}]}'
    src = spark.createDataFrame([(2, 2048, 1, 3)], "files long, bytes long, modules long, functions long")
    lines = [r["line"] for r in review.metrics_report(src, spark.createDataFrame([("a", "xyz")], "path string, content string")).orderBy("ord").collect()]
    assert lines[1] == "source size: 2.0 KB" and lines[-1] == "bytes a generated file: 3"
    names = spark.createDataFrame([("REC", "struct"), ("AB", "string"), ("Q-1", "struct")], "name string, kind string")
    bodies = spark.createDataFrame([(1, "my-rec-x ab"), (2, "r e c q-1"), (3, None)], "id long, b string")
    assert {tuple(r) for r in review.contained(names, bodies, "id", "b").collect()} == {(1, "REC"), (2, "Q-1")}
    row = spark.range(1).select(S.inherited(F.lit(" "), F.lit("base")).alias("a"), S.inherited(F.lit("own"), F.lit("base")).alias("b"), S.sampled(F.lit("t"), 1.0).alias("c"), S.sampled(F.lit("t"), 0.0).alias("d")).first()
    assert tuple(row) == ("base", "own", True, False)
    for bad in (("no-name", None), ("name", 5)):
        with pytest.raises(ValueError):
            io.jdbc_table(spark, "jdbc:none", bad[0], cap=bad[1])
