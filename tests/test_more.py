"""Stores, graphs, windows, gates, metrics, parsers and plug-ins on small rows."""

import json
import random

import pytest
from plumbline import plugins
from plumbline.functions import scalars as S
from plumbline.operators import audit, codegen, diff, fixtures, gates, graph, metrics, parsers, review, snapshots, windows
from plumbline.sources import io, versions
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


# ---- comparisons ----------------------------------------------------------------------


def test_body_equal(spark):
    lit = F.lit
    same = [('{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}'), ("[1, 2]", "[1,2]"), ('{"n":1}', '{"n":1.0}'), ('{"a":null}', '{"a": null}'), ("plain", "plain"), (None, None), ('"é\\u00e9"', '"éé"')]
    other = [("[1,2]", "[2,1]"), ('{"a":1}', '{"a":"1"}'), ("plain", "other"), ("{}", "x"), ('{"a":null}', "{}"), (None, "1"), ('{"a":{"t":1}}', '{"a":{"t":2}}')]
    for pairs, want in ((same, True), (other, False)):
        df = spark.createDataFrame(pairs, "a string, b string").withColumn("same", fixtures.body_equal(F.col("a"), F.col("b"), ["t"]))
        assert [r["same"] for r in df.collect()] == [want] * len(pairs)
    assert one(spark, fixtures.body_equal(lit('{"t":1,"a":2}'), lit('{"a":2,"t":5}'), ["t"]))


def test_diffs(spark):
    before = spark.createDataFrame([(1, "x"), (None, "n"), (3, "c")], "k long, v string")
    after = spark.createDataFrame([(1, "x", "new"), (None, "n", None), (4, "d", None)], "k long, v string, w string")
    assert {(r["k"], r["change"]) for r in diff.row_diff(before, after, ["k"]).collect()} == {(1, "modified"), (3, "deleted"), (4, "inserted")}
    cells = {tuple(r) for r in diff.column_diff(before, after, ["k"], "t", ("*.W",)).collect()}
    assert cells == {(1, "w", None, "new", False)}
    h = lambda rows: diff.table_hash(spark.createDataFrame(rows, "a string, b string"), "t").first()["content_hash"]
    assert h([("a|b", "c")]) != h([("a", "b|c")]) and h([(None, "c")]) != h([("\\N", "c")]) and h([("a", "b"), ("c", "d")]) == h([("c", "d"), ("a", "b")])
    files = spark.createDataFrame([("a", "added"), ("b", "modified")], "path string, change string")
    lines = spark.createDataFrame([("a", 3, 0), ("b", 1, 2)], "path string, lines_added long, lines_removed long")
    assert tuple(diff.files_summary(files, lines).first()) == (1, 0, 1, 4, 2)


def plain_script(old, new):
    m, n = len(old), len(new)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = best[i][j] + 1 if old[i] == new[j] else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], m, n
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append((" ", old[i]))
        elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
            j -= 1
            out.append(("+", new[j]))
        else:
            i -= 1
            out.append(("-", old[i]))
    return out[::-1]


def test_edit_script():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcdxyz"[: r.randint(1, 7)]) for _ in range(r.randint(0, 14))] for _ in range(2))
        if r.random() < 0.5:
            b += a[len(a) // 2 :]
        assert diff.edit_script(a, b) == plain_script(a, b)


def test_hunks(spark):
    old = "\n".join(map(str, range(30)))
    new = old.replace("\n5\n", "\nfive\n").replace("\n25\n", "\n25\nmore\n")
    rows = diff.hunk_lines(spark.createDataFrame([(1, old, new), (2, "a", "a")], "id long, old string, new string"), "id").orderBy("hunk", "ord").collect()
    assert {r["id"] for r in rows} == {1} and [r["old_start"] for r in rows if r["ord"] == 0] == [3, 24]
    assert [(r["op"], r["line"]) for r in rows if r["op"] != " "] == [("+", "five"), ("-", "5"), ("+", "more")] or [(r["op"], r["line"]) for r in rows if r["op"] != " "] == [("-", "5"), ("+", "five"), ("+", "more")]


def test_verdicts(spark):
    texts = ['{"equivalent": true, "reason": "r"}', 'so {"equivalent": false, "reason": "q"} end', '{"reason": "none"}', "equivalent", "not equivalent", "hm", None, "{broken equivalent"]
    got = review.verdict(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [r["equivalent"] for r in got] == [True, False, False, True, False, False, False, True]
    assert [r["reason"] for r in got][:3] == ["r", "q", "none"] and got[5]["reason"] == "could not parse verdict: hm"


# ---- windows --------------------------------------------------------------------------


def test_windows(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 6 + ["a", None]), r.randrange(300), i, r.randrange(-5, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    stretch = F.floor(F.col("t") / 20)
    out = windows.ranked(df, "k", ["t", "i"], stretch, "n")
    out = windows.running(out, "k", ["t", "i"], stretch, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    out = windows.running(out, "k", ["t", "i"], stretch, {"b": ("max", F.col("v"))}, before=True)
    out = windows.lagged(out, "k", ["t", "i"], stretch, "v", "p")
    got = {x["i"]: (x["n"], x["s"], x["m"], x["b"], x["p"]) for x in out.collect()}
    assert len(got) == len(rows)
    for k in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        for j, x in enumerate(own):
            vs = [y[3] for y in own[: j + 1]]
            assert got[x[2]] == (j + 1, sum(vs), max(vs), max(vs[:-1], default=None), vs[-2] if j else None)


def test_paragraphs(spark):
    lines = spark.createDataFrame([("f", i) for i in range(100)] + [("g", i) for i in range(5)], "p string, n long")
    out = parsers.paragraphs(lines, "p", "n", F.when((F.col("n") % 30 == 7) & (F.col("p") == "f"), F.col("n")), F.floor(F.col("n") / 10))
    assert {(x["p"], x["n"]): x["head"] for x in out.collect()} == {("f", i): (i - (i - 7) % 30 if i >= 7 else None) for i in range(100)} | {("g", i): None for i in range(5)}


# ---- graphs ---------------------------------------------------------------------------


def test_call_graph(spark):
    f = spark.createDataFrame([("B", 1, "main", ["helper", "CALL:shared", "GOTO:nowhere"]), ("B", 1, "helper", []), ("A", 2, "helper", []), ("A", 2, "shared", ["main"])], "module string, ord long, name string, calls array<string>")
    none = spark.createDataFrame([], "module string, name string")
    nodes, edges = graph.build(f, none, none)
    calls = {tuple(r) for r in edges.filter("kind <> 'contains'").collect()}
    assert calls == {("fn:B.main", "fn:B.helper", "calls"), ("fn:B.main", "fn:A.shared", "call"), ("fn:B.main", "fn:B.nowhere", "goto"), ("fn:A.shared", "fn:B.main", "calls")}
    more = spark.createDataFrame([("main", "helper"), ("ghost", "shared")], "caller string, callee string")
    merged = graph.merge_calls(edges, f, more)
    assert {tuple(r) for r in merged.exceptAll(edges).collect()} == {("fn:unknown.ghost", "fn:A.shared", "calls")} and nodes.filter("module = 'unknown'").isEmpty()
    deps = {(r["src"], r["dst"]) for r in graph.with_module_edges(edges).filter("kind = 'depends_on'").collect()}
    assert deps == {("mod:B", "mod:A"), ("mod:A", "mod:B")}
    s = graph.stats(nodes, edges).first()
    assert (s["n_module"], s["n_function"], s["hotspot"], s["max_fan_out"]) == (2, 5, "fn:B.main", 3)
    dot = [r["line"] for r in graph.to_dot(nodes, edges).orderBy("ord").collect()]
    assert dot[0] == "digraph dependencies {" and dot[-1] == "}" and sum("subgraph" in x for x in dot) == 2
    assert graph.to_mermaid(nodes, edges).orderBy("ord").first()["line"] == "graph LR"
    assert "nodes 7" in [r["line"] for r in graph.graph_report(nodes, edges).collect()]


def test_components_and_cycles(spark):
    r = random.Random(6)
    edges = {(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(75)}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    want = {a: min(b for b in {y for x, y in reach if x == a} if (b, a) in reach) for a in {x for x, y in reach} if (a, a) in reach}
    assert {x["id"]: x["component"] for x in graph.strong_components(e).collect()} == want
    ids = {x for p in edges for x in p} | {"alone"}
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {x["id"]: x["component"] for x in graph.components(n, e).collect()} == label
    assert graph.strong_components(e.limit(0)).count() == 0 and graph.components(n, e.limit(0)).count() == len(ids)


# ---- stores ---------------------------------------------------------------------------


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.latest(spark, path, "a long").count() == 0
    for n in range(4):
        versions.write(versions.latest(spark, path, "a long").union(spark.createDataFrame([(n,)], "a long")), path)
    assert sorted(r["a"] for r in versions.latest(spark, path, "a long").collect()) == [0, 1, 2, 3]
    io.save_state(spark.createDataFrame([("p", "h")], "path string, hash string"), f"{path}-state")
    assert io.state(spark, f"{path}-state", "path string, hash string").count() == 1 and io.state(spark, f"{path}-none", "path string").count() == 0
    with pytest.raises(Exception):  # a wrong type is an error, not an absent state
        io.state(spark, f"{path}-state", "path int, hash string").collect()


def test_snapshot_store(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/s")
    stages = spark.createDataFrame([(0, "a", "success", 0.4, 10, 1, 2, 3, 0), (1, "b", "failed", 0.9, 5, 1, 1, 1, 2)], snapshots.STAGES.removeprefix("snapshot_id string, "))
    files = lambda *xs: spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(xs)], "ord long, path string, content string")
    say = lambda at: spark.sql(f"SELECT timestamp '{at}' AS created_at, 'cobol' AS source_lang")
    a = store.save(say("2024-01-01 00:00:00"), files(("x/a.txt", "one"), ("b.txt", "two")), stages)
    b = store.save(say("2024-02-01 00:00:00"), files(("x/a.txt", "one"), ("c.txt", None)), stages)
    row = store.load(a).first()
    assert (row["file_count"], row["calls"], row["tokens"], row["duration_ms"], row["score"], len(a)) == (2, 2, 7, 15, 0.9, 16)
    assert [r["id"] for r in snapshots.summaries(store.table("index")).collect()] == [b, a] and store.objects().count() == 3
    store.tag(a, "v1")
    assert store.find("v1").first()["id"] == a and store.find("none").isEmpty()
    assert [r["content"] for r in store.files(b).orderBy("ord").collect()] == ["one", ""]
    store.restore(a, f"file://{tmp_path}/out")
    assert (tmp_path / "out/x/a.txt").read_text() == "one" and (tmp_path / "out/b.txt").read_text() == "two"
    m = store.table("manifests")
    changes = snapshots.compared(m.filter(F.col("snapshot_id") == a), m.filter(F.col("snapshot_id") == b)).collect()
    assert {(r["path"], r["change"]) for r in changes} == {("b.txt", "removed"), ("c.txt", "added")}
    d = store.diff(a, b)
    assert [tuple(r) for r in d["files"].collect()] == [("b.txt", "removed", None, 0, 1), ("c.txt", "added", None, 1, 0)]
    assert tuple(d["summary"].first()) == (0.0, 1, 1, 0, 1, 1) and d["stages"].filter("status_changed or is_new").isEmpty()
    store.delete(a, objects=True)
    assert store.objects().count() == 2
    for call in (lambda: store.load(a), lambda: store.tag("no", "t")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(Exception, match="leaves the folder"):
        versions.write_files(spark.createDataFrame([("../up", "x")], "path string, content string"), f"file://{tmp_path}/out")


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "cpy").mkdir()
    (tmp_path / "src/a.CBL").write_text("A")
    (tmp_path / "cpy/B.cpy").write_text("B")
    (tmp_path / "src/c.txt").write_text("C")
    assert [r["path"] for r in io.source_files(spark, str(tmp_path / "src"), relative=True).collect()] == ["a.CBL"]
    assert [r["content"] for r in io.sibling_books(spark, str(tmp_path / "src")).collect()] == ["B"]
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"kind": "http", "name": "n", "expected_status": 200}\n\n{"kind": "http", "name": "m", "http": {"expected_status": 404}}\n')
    assert [r["expected_status"] for r in io.fixtures(spark, str(good)).orderBy("name").collect()] == [404, 200]
    for line, why in (("{oops", "is no JSON"), ('{"name": "n"}', "has no kind"), ('{"kind": "http"}', "has no name")):
        bad.write_text(line + "\n")
        with pytest.raises(Exception, match=why):
            io.fixtures(spark, str(bad)).collect()
    bad.write_text('{"kind": "http", "name": "n"}\n\n{"kind": "http"}\n')
    with pytest.raises(Exception, match=r"has no name in .*bad.jsonl:3:"):
        io.fixtures(spark, str(bad), numbered=True).collect()
    assert io.fixtures(spark, str(good), numbered=True).count() == 2
    doc = {"modules": [{"name": "M", "path": "m.cbl", "metadata": {"copy_refs": " A , ,B", "copybooks_resolved": "C"}, "functions": [{"name": "f", "calls": ["g"]}, {"name": "g"}]}], "call_graph": {"edges": [{"caller": "f", "callee": "g"}]}}
    (tmp_path / "ir.json").write_text(json.dumps(doc, indent=1))
    t = io.ir_tables(io.ir_documents(spark, str(tmp_path / "ir.json")))
    assert [(r["name"], r["calls"]) for r in t["functions"].orderBy("at").collect()] == [("f", ["g"]), ("g", [])] and t["calls"].count() == 1 and t["rules"].count() == 0
    assert {r["dependency"] for r in io.module_books(t["modules"]).collect()} == {"A", "B", "C.cpy"}
    results = spark.createDataFrame([("n", "http", "c", True, "", ""), ("m", "http", "c", False, "http", "status")], "name string, kind string, correlation_id string, pass boolean, diff_kind string, reason string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    io.write_pack(results, f"file://{tmp_path}/pack", at, at)
    pack = io.proof_packs(spark, str(tmp_path / "pack"))
    assert [(r["pass"], r["fixture_count"], r["fail_count"]) for r in pack.collect()] == [(False, 2, 1)] and [r["name"] for r in io.pack_fixtures(pack).collect()] == ["m", "n"]
    bom = json.loads(io.sbom_document(io.sbom(spark.createDataFrame([("b", "x"), ("a", "y")], "path string, content string"), "app", [("rt", "1")])).first()["sbom"])
    assert [c["name"] for c in bom["components"]] == ["a", "b", "rt"] and bom["metadata"]["component"]["name"] == "app"


# ---- gates, metrics, audit ------------------------------------------------------------


def test_gates(spark):
    m = spark.createDataFrame([("ok", True, 0.9, 10, 10, 5, 5, 100, 0), ("none", True, 0.8, 0, 0, 0, 0, 0, 0), ("bad", False, 0.1, 1, 9, 1, 9, 500, 4), ("low", True, 0.9, 10, 10, 1, 9, 500, 0)], "k string, compiled boolean, score double, fixtures_passed long, fixtures_total long, functions_matched long, functions_total long, tokens long, errors long")
    r = gates.evaluate(m, "k", gates.from_config(gates.Config(max_tokens=200)), scores=True)
    status = {k: [x["status"] for x in r.filter(F.col("k") == k).orderBy("ord").collect()] for k in ("ok", "none", "bad", "low")}
    assert status["ok"] == ["passed"] * 6 and status["none"] == ["passed", "passed", "skipped", "skipped", "passed", "passed"]
    assert status["bad"] == ["failed"] + ["skipped"] * 5 and status["low"] == ["passed", "passed", "passed", "failed", "failed", "passed"]
    table = spark.createDataFrame(gates.settings(gates.Config(max_tokens=200)), gates.SETTINGS)
    assert sorted(map(tuple, gates.configured(m, "k", table).collect())) == sorted(map(tuple, r.collect()))
    own = table.withColumn("k", F.lit("low")).unionByName(spark.createDataFrame([(3, "errors", 9.0, "odd", "bad")], gates.SETTINGS + ", k string"))
    assert {(x["k"], x["gate"], x["severity"], x["status"]) for x in gates.configured(m, "k", own).collect() if x["k"] != "low"} == {("bad", "errors", "required", "passed")}
    all_ = {x["k"]: (x["overall"], x["warnings"]) for x in gates.overall(r, "k").collect()}
    assert all_ == {"ok": (True, 0), "none": (True, 0), "bad": (False, 0), "low": (True, 2)}
    assert len(gates.from_config()) == 5 and gates.evaluate(m, "k", []).count() == 0
    assert tuple(gates.finished(m.limit(0), [], F.lit(True)).first()) == (0, 0, 0, True)
    assert tuple(gates.pack_kpis(spark.createDataFrame([], "fixture_count long, pass_count long, fail_count long")).first()) == (0, 0, 0, 0, 0.0, 0.0)
    v = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("b", True), ("c", False)], "k string, ok boolean")
    assert {x["k"]: x["status"] for x in gates.judge(v, "k", F.col("ok")).collect()} == {"a": "success", "b": "partial", "c": "failed"}


def test_metrics(spark):
    values = [0.0, 5.0, -5.0, 0.1, 1.23456789, -0.5, 1e12, float("inf"), float("nan"), 1e-9]
    got = [r["t"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(metrics.number_text(F.col("v")).alias("t")).collect()]
    assert got == ["0", "5", "-5", "0.1", "1.234567", "-0.5", "1000000000000", "+Inf", "NaN", "0"]
    m = spark.createDataFrame([("c", "counter", "h", {"b": "2", "a": "1"}, 3.0)], "name string, kind string, help string, labels map<string,string>, value double")
    m = m.withColumns({"buckets": F.lit(None).cast("array<struct<le:double,n:long>>"), "sum": F.lit(None).cast("double"), "count": F.lit(None).cast("long")})
    assert [r["line"] for r in metrics.exposition(m).orderBy("ord").collect()] == ["# HELP c h", "# TYPE c counter", 'c{a="1",b="2"} 3']
    e = one(spark, audit.compiled(F.lit("java"), F.lit(3), F.lit(False), F.lit(7), F.array(F.lit("x"), F.lit("y"))))
    assert (e["event_type"], e["message"], e["success"], e["details"]["errors"], e["duration_ms"]) == ("compile", "Compiled 3 java files", False, "x\ny", 7)
    for made in (audit.agent_start(F.lit("a"), F.lit("w"), F.create_map(F.lit("p"), F.lit("q"))), audit.db_snapshot(F.array(F.lit("t")), F.lit(4), F.lit(1)), audit.proof_pack(F.lit("o"), F.lit(3), F.lit(2)), audit.workflow_start(F.lit("w"), F.lit("a"), F.lit("b"), F.lit("p"))):
        assert one(spark, made)["message"]


def test_scalars(spark):
    assert one(spark, S.deterministic_id(F.lit("a"), F.lit(None))) != one(spark, S.deterministic_id(F.lit(None), F.lit("a")))
    reply = "import x from 'y';\nconst z = require('z');\nfunction f() {\n  return 1;\n}\nThis adds one.\nmore"
    assert one(spark, S.strip_prose(F.lit(reply))) == "return 1;" and one(spark, S.strip_prose(F.lit("\n\nexport function f() {\n  a;\n}\n"))) == "function f() {\n  a;\n}"
    assert [one(spark, S.is_retryable(F.lit(t))) for t in ("context canceled", "context deadline exceeded")] == [False, True]
    assert 1000 <= one(spark, S.jittered(F.lit(1000), F.lit("s"))) <= 1250


# ---- parsers and plug-ins -------------------------------------------------------------


def test_parser_rules(spark):
    of = lambda lang, path, text: list(parsers.PARSERS[lang](path, text))
    assert not parsers.is_fixed(["DISPLAY A.", "DISPLAY X."]) and parsers.is_fixed(["       MOVE A", "      * note"])
    free = of("cobol", "a.cbl", "PROGRAM-ID. P.\nPROCEDURE DIVISION.\nMAIN.\nDISPLAY X. *> CALL 'Q'\n")
    assert ("io", "", "MAIN", "display:write") in free and not any(r[0] == "call" for r in free)
    subs = "package A;\nsub a ($x, $y) { }\nsub b {\n my @all = @_;\n}\nsub c {\n my $self = shift;\n my $n = shift;\n my $z = 1;\n my $late = shift;\n}\nsub d { my ($p, %q) = @_; }\n"
    assert [(r[1], r[2], r[3]) for r in of("perl", "A.pm", subs) if r[0] == "parameter"] == [("x", "a", "unknown"), ("y", "a", "unknown"), ("all", "b", "array"), ("self", "c", "unknown"), ("n", "c", "unknown"), ("p", "d", "unknown"), ("q", "d", "unknown")]
    code = "subroutine s(a)\n integer a\n do i = 1, 3\n  if (a > 1) then\n  end if\n end do\n associate (z => a)\n end associate\n call inner(a, &\n   2)\n inquire(file='x')\nend subroutine\ncall outer()\n"
    rows = of("fortran", "s.f90", code)
    assert ("call", "inner", "s", "call") in rows and ("io", "inquire", "s", "io") in rows and ("call", "outer", "", "call") in rows and ("variable", "a", "s", "integer scalar") in rows
    parsed = spark.createDataFrame([("p", 0, "data_type", "X-REC", "", "unknown(0,0)"), ("p", 1, "data_type", "Y", "", "unknown(0,0)")], "path string, ord long, record string, name string, parent string, detail string")
    books = spark.createDataFrame([("b", 0, "data_type", "x-rec", "", "struct(0,0)")], parsed.schema)
    assert [r["detail"] for r in parsers.resolved_types(parsed, books).orderBy("ord").collect()] == ["struct(0,0)", "unknown(0,0)"]


def test_snippets(spark):
    code = "x;\n/**\n * doc\n */\n  doIt(a) {\n  if (a) { b; }\n}\nother() {}\n"
    df = spark.createDataFrame([(1, code, "doIt"), (2, code, "none"), (3, "z" * 2500, "none"), (4, "async go() {\n}\n", "go")], "id long, code string, name string")
    got = {r["id"]: r["snippet"] for r in parsers.function_snippets(df, "id", "code", "name").collect()}
    assert got[1] == "/**\n * doc\n */\n  doIt(a) {\n  if (a) { b; }\n}" and got[2] == code and got[3].endswith("(truncated)...") and got[4] == "async go() {\n}"


def test_plugins(spark):
    with pytest.raises(KeyError, match="there are"):
        plugins.SOURCES.get("ada")
    with pytest.raises(KeyError, match="registered already"):
        plugins.TARGETS.register("java", None)
    assert plugins.provider("none") is None and plugins.provider("stub").name == "stub" and plugins.GATES.names()[0] == "compilation"
    docs = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [len(r["v"]) for r in plugins.embedded(docs, "t", "v", plugins.Stub()).collect()] == [8, 8]
    short = plugins.Stub()
    short.embed = lambda texts: []
    with pytest.raises(Exception, match="0 answers to"):
        plugins.embedded(docs, "t", "v", short).collect()
    assert plugins.manifest('{"run_fixture": {"cmd": "x"}}')["compile"] == []
    for bad in ("{", "{}"):
        with pytest.raises(ValueError):
            plugins.manifest(bad)
    assert [x[1] for x in plugins.health({"a": lambda: "", "b": lambda: 1 / 0})] == ["healthy", "unhealthy"]
    f = spark.createDataFrame([("my-mod", 0, "do-it"), ("empty", 0, None)], "module string, ord long, function string")
    files = {r["path"]: r["content"] for r in plugins.TARGETS.get("java")(f).collect()}
    assert "public void doIt()" in files["src/main/java/generated/MyModService.java"] and files["src/main/java/generated/EmptyService.java"].endswith("{\n}\n")
    assert codegen.all_files(codegen.generate(f, "go"), codegen.generate_tests(f, "typescript")).count() == 4
    fields = spark.createDataFrame([("T-REC", 1, "B-X", "integer", 12), ("T-REC", 0, "A", "array<string>", 3)], "type string, ord long, field string, kind string, size int")
    assert tuple(codegen.type_models(fields, "go").first()) == ("TRec", "a: []string\nbX: int64")
