"""Operators on small hand-made rows."""

from plumbline.functions import scalars as S
from plumbline.operators import copybooks, diff, fixtures, graph, parsers, pii, review, windows
from plumbline.sources import io
from pyspark.sql import functions as F

from tests import parser_samples as samples


def test_line_diff(spark):
    p = spark.createDataFrame([(1, "line1\nline2\nline3\n", "line1\nmodified\nline3\nnewline\n"), (2, "a", "a")], "id long, old string, new string")
    got = {r["id"]: tuple(r)[1:] for r in diff.line_diff(p, "id").collect()}
    assert got == {1: (2, 1, 1), 2: (0, 0, 0)}


def test_row_diff_is_symmetric(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, v string")
    b = spark.createDataFrame([(1, None), (2, ""), (4, "z")], "k long, v string")
    assert diff.row_diff(a, a, ["k"]).count() == 0
    assert {(r["k"], r["change"]) for r in diff.row_diff(a, b, ["k"]).collect()} == {(2, "modified"), (3, "deleted"), (4, "inserted")}


def test_pii(spark):
    df = spark.createDataFrame([("My SSN is 123-45-6789",), ("Card: 4111-1111-1111-1111",), ("Call me at (555) 123-4567",), ("born 01/02/1990 at 10.0.0.1",), ("é123-45-6789",)], "text string")
    types = [r["type"] for r in pii.detect(df, "text", []).collect()]
    assert sorted(types) == ["credit_card", "date_of_birth", "ip_address", "phone", "ssn", "ssn"]
    assert df.select(pii.mask_text(F.col("text")).alias("m")).first()["m"] == "My SSN is [REDACTED:ssn]"


def test_pii_places_and_masking_in_one_pass(spark):
    texts = ["é𝄞 a@b.co, a@b.co and 123-45-6789", None, "", "none", "4111-1111-1111-1111", "4111-1111-1111-1111", "x 12345678 at 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "id long, text string")
    got = pii.locate(df, "text", ["id"]).collect()
    assert all(texts[r["id"]][r["start"] : r["end"]] == r["value"] for r in got)
    plain = pii.detect(df, "text", ["id"]).collect()
    assert sorted((r["id"], r["type"], r["value"]) for r in got) == sorted(tuple(r) for r in plain)
    assert sorted(r["start"] for r in got if r["type"] == "email") == [3, 3, 11, 11]
    assert [(r["value"], r["start"]) for r in pii.locate(df, "text", ["id"], ("none",), {"none": "no|ne"}).filter("id = 3").orderBy("start").collect()] == [("no", 0), ("ne", 2)]
    masked = {r["id"]: r["m"] for r in df.select("id", pii.mask_once(F.col("text")).alias("m")).collect()}
    assert masked[0] == "é𝄞 [REDACTED:email], [REDACTED:email] and [REDACTED:ssn]" and masked[1] is None and masked[2] == "" and masked[3] == "none"
    assert masked[4] == "[REDACTED:credit_card]" and masked[6] == "x [REDACTED:account_number] at [REDACTED:ip_address]"
    assert df.select(pii.mask_once(F.col("text"), "partial", ("ssn",)).alias("m")).first()["m"] == "é𝄞 a@b.co, a@b.co and ***-**-6789"
    assert pii.locate(df.limit(0), "text", ["id"]).count() == 0


def test_fixtures(spark):
    row = lambda s, h, a, b: (200, s, {"A": "1"}, {"a": h}, a, b)
    rows = [row(200, "1", '{"a":1,"b":2}', '{"b":2,"a":1}'), row(500, "1", "x", "x"), row(200, "2", "x", "x"), row(200, "1", '{"a":1}', '{"a":2}'), row(200, "1", '{"ok":true,"ts":1}', '{"ts":2,"ok":true}')]
    df = spark.createDataFrame(rows, "expected_status int, status int, expected_header map<string,string>, header map<string,string>, expected_body string, body string")
    assert [r["reason"] for r in fixtures.compare(df, ["ts"]).collect()] == [None, "status", "header", "body", None]


def test_parsers():
    of = lambda lang: list(parsers.PARSERS[lang](*samples.FILES[lang][0]))
    cobol = of("cobol")
    assert ("data_type", "EMP-NAME", "EMPLOYEE-RECORD", "string(30,0)") in cobol and ("data_type", "PAY-BASE", "EMP-PAY", "decimal(9,2)") in cobol
    assert ("call", "TAXCALC", "MAIN-PARA", "call") in cobol and [r[1] for r in cobol if r[0] == "function"] == ["MAIN-PARA", "READ-PAY", "FINISH"]
    perl = of("perl")
    assert ("dependency", "Moose::Role", "Shop::Cart", "oop") in perl and ("function", "check", "save", "closure") in perl
    fortran = of("fortran")
    assert ("io", "write", "solve", "io") in fortran and ("function", "norm", "linear", "function") in fortran


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    assert {r["id"]: r["component"] for r in graph.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r["id"] for r in graph.on_cycle(e, 5).collect()} == {"a", "b", "c"}


def test_scores(spark):
    one = lambda *a: round(spark.range(1).select(S.gate_score(*a).alias("s")).first()["s"], 6)
    lit = F.lit
    assert one(lit(True), lit(90), lit(100), lit(0), 5, lit(1.0)) == 0.45
    assert one(lit(False), lit(90), lit(100), lit(0), 5, lit(1.0)) == 0
    assert one(lit(True), lit(85), lit(100), lit(2), 5, lit(1.8), 0.8) == 1.0


def test_nested_pii(spark):
    ssn = "123-45-6789"
    kind = "id long, a struct<b:array<string>,n:int>, m map<string,struct<c:string>>"
    df = spark.createDataFrame([(1, (["x", None, ssn], 5), {"k": (f"is {ssn}",)}), (2, None, None), (3, ([], None), {"k": None})], kind)
    got = {(r["id"], r["path"], r["type"], r["value"]) for r in pii.detect_nested(df, ["id"]).collect()}
    assert got == {(1, "a.b[2]", "ssn", ssn), (1, "m.k.c", "ssn", ssn)}
    masked = df.select("id", *[pii.mask_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields[1:]])
    rows = {r["id"]: r for r in masked.collect()}
    assert rows[1]["a"]["b"] == ["x", None, "[REDACTED:ssn]"] and rows[1]["a"]["n"] == 5 and rows[1]["m"]["k"]["c"] == "is [REDACTED:ssn]"
    assert rows[2]["a"] is None and rows[2]["m"] is None and rows[3]["m"] == {"k": None}
    assert pii.detect_nested(df.select("id"), ["id"]).count() == 0


def test_copy_expansion(spark):
    files = spark.createDataFrame(samples.FILES["copy"] + [("src/loop.cpy", "X ==A== COPY LOOP."), ("src/self.cbl", "COPY LOOP.\nEND"), ("src/empty.cbl", None)], "path string, content string")
    out, told = copybooks.expand(files.filter("path like '%.cbl'"), copybooks.library(files))
    text = {r["path"]: r["content"] for r in out.collect()}
    lines = text["src/billing.cbl"].split("\n")
    assert lines[4:9] == ["      * COPY NOTHING.", "       01 BILL-RECORD.", "          05 BILL-NAME PIC X(12).", "          05 PAID PIC 9(5)V99.", ""]
    assert lines[9] == "      *    COPY DFHAID." and text["src/empty.cbl"] == ""
    assert text["src/self.cbl"] == "X ==A== COPY LOOP.\nEND"
    assert {(r["path"], r["book"]) for r in told.collect()} == {("src/billing.cbl", "DFHAID"), ("src/self.cbl", "LOOP")}
    assert copybooks.replace_words("  A-PRE PRE-A. pre-b X-PRE.", [["TRAILING", "-PRE", "-Z"], ["LEADING", "PRE-", "Q-"], ["", "", "!"]]) == "  A-Z Q-A. Q-b X-Z."
    got = parsers.construct_counts(parsers.parse(files.filter("path = 'src/billing.cbl'"), "cobol_constructs")).collect()
    assert [tuple(r)[1:] for r in got] == [("MAIN-PARA", 1, 1, 1, 1, 1)]


def test_previous(spark):
    rows = [(k, i) for k in ("a", "b", None) for i in range(0, 60, 1 if k == "a" else 7)] + [("a", 1000), ("c", 5)]
    got = windows.previous(spark.createDataFrame(rows, "k string, i long"), "k", "i", "p", width=10).collect()
    want = {(k, i): max([j for q, j in rows if q == k and j < i], default=None) for k, i in rows}
    assert len(got) == len(rows) and {(r["k"], r["i"]): r["p"] for r in got} == want


def test_byte_cap(spark):
    texts = ["a" * 12, "aé" * 6, "日本語テキスト", "😀😀😀😀", "ab😀é日", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(4, 14):
        got = [r[0] for r in df.select(S.byte_cap(F.col("t"), n)).collect()]
        assert got == [t if t is None else t.encode()[:n].decode(errors="ignore") for t in texts]


def test_requests(spark):
    df = spark.createDataFrame([("429 TPD", 0), ("Too Many Requests", 1), ("502", 1), ("x 403", 1), ("odd", 1), (None, 1)], "e string, n int")
    assert [r[0] for r in df.select(S.is_retryable(F.col("e"))).collect()] == [False, True, True, False, True, False]
    assert [r[0] for r in df.select(S.wait_ms(F.col("n"), 25, F.lit(0), F.lit(50_000))).collect()][:2] == [2400, 10_000]
    told = df.limit(1).select(S.config_warnings(F.lit("p"), F.lit(""), F.lit(2.5), F.lit(-1)).alias("a"), S.config_warnings(F.lit("none"), F.lit(None), F.lit(0.0), F.lit(5)).alias("b")).first()
    assert len(told["a"]) == 3 and told["b"] == []


def test_proof_packs(spark, tmp_path):
    for name, body in (("a b", '{"pass": true, "fixture_count": 1, "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:00:02Z", "results": [{"name": "n", "kind": "http", "diff": {"pass": true}}]}'), ("bad", "{oops")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(body)
    packs = io.proof_packs(spark, str(tmp_path))
    got = packs.collect()
    assert [(r["dir"], r["pass"], r["millis"]) for r in got] == [(str(tmp_path / "a b"), True, 2000)] and len(got[0]["id"]) == 16
    assert [r["name"] for r in io.pack_fixtures(packs).collect()] == ["n"]


def test_imports(spark):
    src = "module consts\n  real :: pi\nend module consts\nsubroutine area(r)\n  use CONSTS\nend subroutine area\n"
    got = parsers.imported(parsers.parse(spark.createDataFrame([("a.f90", src)], "path string, content string"), "fortran")).collect()
    assert [tuple(r) for r in got] == [("a.f90", "area", "consts", "pi")]
    assert review.source_metrics(spark.createDataFrame([], "path string, content string"), spark.createDataFrame([], "record string")).first()["files"] == 0


def test_fixture_faults(spark):
    """A null status is not the one expected; header names that differ in case alone are no error."""
    rows = [(200, None, {"X-A": "1"}, {"x-a": "1", "X-a": "1"}), (None, None, {"X-A": "2"}, {"x-a": "1", "X-a": "1"}), (None, 200, {"x-b": "1"}, {"X-B": "1", "x-B": "1"}), (200, 200, None, None)]
    df = spark.createDataFrame(rows, "expected_status int, status int, expected_header map<string,string>, header map<string,string>").withColumns({"expected_body": F.lit(None).cast("string"), "body": F.lit("x")})
    assert [r.reason for r in fixtures.compare(df).collect()] == ["status", "header", None, None]
