"""Work is dealt to many tasks and done once, however small the files are that it comes from."""

import os
import random
import re

import numpy as np
from pyspark.sql import DataFrameWriter, Row, functions as F

import __spark_entry__ as entry
from plumbline.operators import copybooks, parsers, perl_code, review, vectors
from plumbline.plans import documents, samples
from plumbline.streaming import run_processor

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_sources_are_made_in_many_tasks(spark):
    for language in ("cobol", "perl", "fortran"):
        assert tasks_with_rows(samples.files(spark, DIR, language)) > 4


def test_parameters_read_one_parse(spark):
    parsed = parsers.parse(samples.files(spark, DIR, "fortran"), "fortran")
    assert plan_of(parsers.typed_parameters(parsed)).count("MapInArrow") == 1


def test_parameters_declared_twice_or_nowhere(spark):
    rows = [("a", 0, "parameter", "p", "f", "unknown"), ("a", 1, "variable", "P", "f", "real scalar"), ("a", 2, "variable", "p", "f", "late"), ("a", 3, "parameter", "q", "f", "unknown"), ("b", 4, "parameter", "p", "f", "unknown"), ("a", 5, "parameter", "p", "f", "unknown")]
    df = spark.createDataFrame(rows, "path string, ord long, record string, name string, parent string, detail string")
    assert sorted(tuple(r) for r in parsers.typed_parameters(df).collect()) == [("a", "f", 0, "p", "real scalar"), ("a", "f", 3, "q", "unknown"), ("a", "f", 5, "p", "real scalar"), ("b", "f", 4, "p", "unknown")]


def test_upsert_where_added_keys_are_there_already(spark, tmp_path):
    rows = [(i, [1.0], i % 7) for i in (0, 1, 3, 50, 100, 150, 100_000, 100_050, 100_101, 200_000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted([(i, -1 if i % 3 == 0 else n) for i, _, n in rows] + [(i + 100_000, -2) for i, _, _ in rows if i % 50 == 0])
    assert sorted(tuple(r) for r in entry.queries()["vector_upsert"](spark, str(tmp_path)).collect()) == want


def test_imports_read_one_parse(spark):
    parsed = parsers.parse(samples.files(spark, DIR, "fortran"), "fortran")
    assert "MapInArrow" not in plan_of(parsers.imported(parsed))  # it is stored


def test_lines_between_copies_are_one_segment(spark):
    text = "\n".join(["A.", " B", " COPY X.", " C.", " D."])
    files = spark.createDataFrame([("p.cbl", text)], "path string, content string")
    got = copybooks._split(files.selectExpr("path", "cast(array() as array<int>) as ord", "cast(array() as array<array<string>>) as pairs", "content"), True)
    assert [(r["book"], r["text"]) for r in got.orderBy("ord").collect()] == [(None, "A.\n B"), ("X", " COPY X."), (None, " C.\n D.")]


def test_perl_code_is_read_in_runs(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(perl_code, "_pattern_may_begin", lambda code: joins.append(code) or False)
    got = perl_code.code_lines("my $query = $total / 2; say 'it''s /'; my $sum = q{a}b} + tr; # end\n$x = s/a/b/ y;")
    assert [x.bare for x in got] == ["my $query = $total / 2; say ''''; my $sum = ''b} + tr; ", "$x = '' y;"]
    assert joins == ["my $query = $total "]


def test_vectors_meet_in_blocks_of_queries_and_bins_of_like_size(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_QUERIES", 3)
    monkeypatch.setattr(vectors, "BLOCK", 10)
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, size=(90, 3)) * 1.0 + 0.5
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors.search(store, store.filter("id % 6 = 0").withColumnRenamed("id", "q"), "q", "id", "v", 4).collect()
    u = x / np.sqrt((x * x).sum(1))[:, None]
    want = {(q, i) for q in range(0, 90, 6) for i in sorted(range(90), key=lambda i: (-round(float(u[q] @ u[i]), 5), i))[:4]}
    assert {(g.q, g.id) for g in got} == want
    bins = vectors._bins(u[:30], [(c, 200 if c == 7 else 10) for c in range(30)], 4)
    rows = {}
    for c, (first, n) in bins.items():
        for b in range(first, first + n):
            rows[b] = rows.get(b, 0) + (200 if c == 7 else 10) / n
    assert len(rows) >= 16 and max(rows.values()) <= 31 and sorted(rows) == list(range(len(rows)))


def test_runs_of_a_bucket_cost_one_read_and_one_write():
    class Handle:
        calls, held, due = [], None, []
        getValueState = lambda self, name, schema: self
        get = lambda self: self.calls.append("get") or self.held
        registerTimer = lambda self, at: self.due.append(at)
        deleteTimer = lambda self, at: self.due.remove(at)
        getCurrentWatermarkInMs = lambda self: 0

        def update(self, value):
            self.calls.append("update")
            self.held = value

    h = Handle()
    fold = run_processor.RunFold(1000)
    fold.init(h)
    rows = [Row(run=f"r{i % 50}", kind="stage.started", stage="s", us=i * 1000, seq=i, value=0) for i in range(100)]
    out = list(fold.handleInputRows((1,), iter(rows), h))
    assert sorted((r["run"], r["n_events"], r["stages"][0]["n_starts"]) for r in out) == sorted((f"r{i}", 2, 2) for i in range(50))
    assert h.calls == ["get", "update"] and h.due == [50 + 1 + 1]


def test_documents_are_made_in_many_tasks(spark):
    assert tasks_with_rows(documents.documents(spark, DIR)) > 4
    assert tasks_with_rows(entry.queries()["json_normalize_compare"](spark, DIR)) > 4


def test_scopes_of_a_chain_write_a_table_a_round(spark, monkeypatch):
    files = spark.createDataFrame([(f"{i}.f90", f"module m{i}\nuse m{i - 1}\nreal :: x{i}\nend module") for i in range(1, 5)], "path string, content string")
    parsed, write, made = parsers.parse(files, "fortran"), DataFrameWriter.parquet, []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: made.append(path) or write(self, path))
    got = {tuple(r) for r in parsers.scopes(parsed).collect()}
    assert got == {(f"M{i}", f"X{j}", f"M{j}", f"X{j}", "variable") for i in range(1, 5) for j in range(1, i)}
    assert len(made) == 3 + 4  # records, uses and own names; three rounds that find names and one that does not


def plain_scopes(records):
    """The same by going over all USE statements until nothing is added."""
    up = [(r, n.upper(), p.upper(), d) for r, n, p, d in records]
    uses = {}
    for r, n, p, d in up:
        if r == "dependency":
            uses.setdefault((p, n), []).append(d == "use only")
    named = {(p, d.upper().split(":")[0], d.upper().split(":")[1], n) for r, n, p, d in up if r == "import"}
    said = {(p, n): max(d for r, m, q, d in up if r == "access" and (q, m) == (p, n)) for r, n, p, _ in up if r == "access" and n}
    shut = {p for r, n, p, d in up if r == "access" and not n and d == "private"}
    modules = {n for r, n, _, d in up if r == "module" and d == "module"}
    on = lambda u, n: u in modules and said.get((u, n), "private" if u in shut else "public") == "public"
    found, offered = set(), {(p, n, p, n, r) for r, n, p, _ in up if r in ("variable", "data_type", "function") and on(p, n)}
    while True:
        new = set()
        for (unit, by), only in uses.items():
            for u, n, *rest in offered:
                if u == by:
                    names = [x for p, m, t, x in named if (p, m, t) == (unit, by, n)] or ([] if all(only) else [n])
                    new |= {(unit, x, *rest) for x in names}
        if new <= found:
            return found
        found |= new
        offered |= {x for x in new if on(x[0], x[1])}


def test_scopes_where_ways_meet_and_turn_back(spark):
    """Names that come over ways of several lengths, rings, names under two names that meet again."""
    r = random.Random(57)
    sources = ["module a\nreal :: x, y\nend module", "module b\nuse a, p => x, q => x\nend module", "module c\nuse b, one => p, one => q\nuse a, one => x\nend module", "module d\nuse d, again => z\nuse e\nreal :: z\nend module", "module e\nuse d\nend module", "module f\nuse f\nreal :: w\nend module"]
    for i in range(9):
        text = f"module m{i}\n"
        for j in r.sample(range(9), 2) if i % 3 else [(i + 4) % 9]:
            text += f"use m{j}" + r.choice(["", "", f", k{i} => v{j}", f", only: v{j}, t{i} => v{(j + 1) % 9}"]) + "\n"
        text += r.choice(["private\npublic v%d\n" % ((i + 1) % 9), "private v%d\n" % ((i + 2) % 9), "", "", "", ""])
        sources.append(text + f"real :: v{i}\nend module")
    files = spark.createDataFrame([(f"{i}.f90", x) for i, x in enumerate(sources)], "path string, content string")
    got = [tuple(x) for x in parsers.scopes(parsers.parse(files, "fortran")).collect()]
    want = plain_scopes([x for i, s in enumerate(sources) for x in parsers.fortran(f"{i}.f90", s)])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_fortran_patterns_are_tried_where_they_may_begin(monkeypatch):
    class Tried:
        def __init__(self, pattern):
            self.pattern, self.texts = pattern, []

        def match(self, x):
            self.texts.append(x)
            return self.pattern.match(x)

    names = ("_UNIT", "_USE", "_ACCESS", "_FORTRAN_IO", "_DECLARED", "_DERIVED", "_END")
    for name in names:
        monkeypatch.setattr(parsers, name, Tried(getattr(parsers, name)))
    got = list(parsers.fortran("a.f90", "subroutine s\nuse m\n  REAL :: x, y(2)\nPrint *, x\nu = 1\nend"))
    assert [r[1] for r in got] == ["s", "m", "x", "y", "print"]
    assert [getattr(parsers, n).texts for n in names] == [["subroutine s"], ["use m", "u = 1"], ["Print *, x"], ["  REAL :: x, y(2)", "Print *, x"], ["  REAL :: x, y(2)"], [], ["end"]]
    # letters that are folded to ASCII ones: a long s, a dotless i, a Kelvin sign
    assert [r[:2] for r in parsers.fortran("a.f90", "ſubroutine s\nuſe m\nıf (a) call k\nınteger i")] == [("function", "s"), ("dependency", "m"), ("call", "k"), ("variable", "i")]


def test_names_found_leave_a_body_and_no_words(spark, monkeypatch):
    texts = ["a recording, é-rec2 xx", "RECREC q-1x\n_q-1", "no ſrec", "", None, "REcording recording re" + "x" * 300, "ß\0rec_A éq-1é"]
    bodies = spark.createDataFrame([(i // 2, x) for i, x in enumerate(texts)] + [(0, texts[0])], "id long, b string")
    names = spark.createDataFrame([("rec", "struct"), ("q-1", "struct"), ("Recording", "struct"), ("r é", "struct"), ("xx", "string"), ("", "struct"), (None, "struct")], "name string, kind string")
    up = lambda x: "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in x or "")
    want = sorted({(i // 2, n) for i, x in enumerate(texts) for n in ("REC", "Q-1", "RECORDING") if n in up(x)})
    words = sorted((i // 2, w) for i, x in enumerate([*texts, texts[0]]) for w in set(re.findall("[A-Z0-9_-]+", up(x))) & {"REC", "Q-1", "RECORDING", "XX"} for i in [i if i < len(texts) else 0])
    few = review.contained(names, bodies, "id", "b"), review.mentions(names, bodies, "id", "b")
    assert not any("Join" in plan_of(x) or "Generate" in plan_of(x) for x in few)
    monkeypatch.setattr(review, "TASK_NAMES", 1)
    many = review.contained(names, bodies, "id", "b"), review.mentions(names, bodies, "id", "b")
    assert all("Join" in plan_of(x) for x in many)
    for found, said in (few, many):
        assert sorted(map(tuple, found.collect())) == want and sorted(map(tuple, said.collect())) == words
    assert len(want) > 5 and len(words) > 3
    monkeypatch.setattr(review, "TASK_NAMES", 100)
    monkeypatch.setattr(review, "FEW_NAMES", 1)
    monkeypatch.setattr(review, "HELD_WORDS", 1)
    assert sorted(map(tuple, review.contained(names, bodies, "id", "b").collect())) == want
    assert review._parts({b"B", b"BC", b"X"})(b"ABC.BCB Y C-X") == {b"B", b"BC", b"X"} and review._parts(set())(b"A") == []
