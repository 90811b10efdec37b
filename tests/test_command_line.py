"""The command line on small folders."""

import json

import pytest
from plumbline import __main__ as cli
from plumbline.operators import snapshots


def run(capsys, *argv):
    capsys.readouterr()
    code = cli.main([str(x) for x in argv])
    return code, capsys.readouterr().out.strip().split("\n")


def test_incremental(spark, tmp_path, capsys):
    src, state = tmp_path / "src", f"file://{tmp_path}/state"
    src.mkdir()
    (src / "a.cbl").write_text("       DATA DIVISION.\n           COPY BOOK.\n")
    (src / "book.cpy").write_text("       01 A PIC X.\n")
    (src / "c.cbl").write_text("       DATA DIVISION.\n")
    go = lambda *more: run(capsys, "incremental", "analyze", state, src, *more)[1]
    assert go() == ["new: 3", "new a.cbl", "new book.cpy", "new c.cbl"]
    assert go() == ["unchanged: 3"]
    (src / "book.cpy").write_text("       01 B PIC X.\n")
    (src / "c.cbl").unlink()
    assert go("--dry") == ["changed: 2", "deleted: 1", "changed a.cbl", "changed book.cpy", "deleted c.cbl"]
    assert go("--force")[0] == "changed: 2" and go() == ["unchanged: 2"]
    assert run(capsys, "incremental", "status", state)[1] == ['{"files":2}']
    run(capsys, "incremental", "reset", state)
    assert go()[0] == "new: 2"


def test_graph_and_parse(spark, tmp_path, capsys):
    doc = {"modules": [{"name": "M", "path": "m", "functions": [{"name": "f", "calls": ["g"]}, {"name": "g"}], "io_contracts": [{"name": "out", "kind": "file", "direction": "write"}]}, {"name": "N", "path": "n", "functions": [{"name": "h", "calls": ["f"]}]}], "call_graph": {"edges": [{"caller": "g", "callee": "lost"}]}}
    (tmp_path / "ir.json").write_text(json.dumps(doc))
    stats = run(capsys, "depgraph", tmp_path / "ir.json")[1]
    assert "nodes 6" in stats and "edges 9" in stats and "module N 1" in stats
    dot = run(capsys, "depgraph", tmp_path / "ir.json", "--format", "dot")[1]
    assert dot[0].startswith("digraph") and any('"fn:M.g" -> "fn:unknown.lost"' in x for x in dot)
    assert run(capsys, "depgraph", tmp_path / "ir.json", "--format", "mermaid")[1][0] == "graph LR"
    assert len(run(capsys, "depgraph", tmp_path / "ir.json", "--format", "json")[1]) == 15
    (tmp_path / "s.f90").write_text("subroutine s\nend subroutine\n")
    assert json.loads(run(capsys, "parse", "fortran", tmp_path, "--ext", "f90")[1][0])["name"] == "s"


def test_snapshots_gates_and_packs(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/store"
    store = snapshots.Store(spark, root)
    stages = spark.createDataFrame([], snapshots.STAGES.removeprefix("snapshot_id string, "))
    ids = [store.save(spark.sql(f"SELECT timestamp '2024-01-0{k} 00:00:00' AS created_at"), spark.createDataFrame([(0, "a", t)], "ord long, path string, content string"), stages) for k, t in ((1, "x"), (2, "x\ny"))]
    run(capsys, "snapshot", root, "tag", ids[0], "first")
    assert [json.loads(x).get("tag") for x in run(capsys, "snapshot", root, "list")[1]] == [None, "first"]
    assert json.loads(run(capsys, "snapshot", root, "diff", *ids)[1][0])["change"] == "modified" and len(run(capsys, "snapshot", root, "show", ids[1])[1]) == 2
    run(capsys, "snapshot", root, "restore", ids[1], f"file://{tmp_path}/back")
    assert (tmp_path / "back/a").read_text() == "x\ny"
    run(capsys, "snapshot", root, "delete", ids[0])
    assert len(run(capsys, "snapshot", root, "list")[1]) == 1
    with pytest.raises(SystemExit):
        cli.main(["snapshot", root, "show"])
    rows = [{"run": "a", "compiled": True, "score": 0.9, "fixtures_passed": 1, "fixtures_total": 1, "functions_matched": 1, "functions_total": 1, "tokens": 5, "errors": 0}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    code, said = run(capsys, "gate", tmp_path / "m.json")
    assert code == 0 and said[0] == "PASSED   compilation (critical)"
    (tmp_path / "m.json").write_text(json.dumps(rows[0] | {"score": 0.1}))
    assert run(capsys, "gate", tmp_path / "m.json")[0] == 1
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs/summary.json").write_text('{"pass": true, "fixture_count": 2, "pass_count": 2, "fail_count": 0, "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:00:01Z", "results": []}')
    assert json.loads(run(capsys, "packs", tmp_path / "packs")[1][1])["pass_rate"] == 1.0
