"""``python -m plumbline``: the engine's operators from the command line.

Each command reads files or tables, runs operators, and prints rows or writes tables. The session
is the one that Spark's own configuration gives (spark-submit, or a local one).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import fingerprint, gates, graph, parsers, review, snapshots
from plumbline.sources import io, versions

STATE = "path string, file_hash string, composite_hash string"


def show(df: DataFrame, order: list[str] = ()) -> None:
    """Prints rows as JSON lines, batch by batch."""
    for r in (df.orderBy(*order) if order else df).toJSON().toLocalIterator():
        print(r)


def lines(df: DataFrame, order: list[str]) -> None:
    for r in df.orderBy(*order).select("line").toLocalIterator():
        print(r["line"])


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of all sources of a language under a folder."""
    out = parsers.parse(io.source_files(spark, a.path, a.ext, relative=True), a.language)
    if a.out:
        versions.write(out, a.out)
    else:
        show(out, ["path", "ord"])


def depgraph(spark: SparkSession, a: argparse.Namespace) -> None:
    """The call graph of IR documents, as text of a format or as a summary."""
    t = io.ir_tables(io.ir_documents(spark, a.ir))
    functions = t["functions"].select("module", "ord", "name", "calls")
    named = lambda n: t[n].select("module", "name")
    nodes, edges = graph.build(functions, named("data_types"), named("io"))
    edges = graph.with_module_edges(graph.merge_calls(edges, functions, t["calls"]))
    if a.format == "json":
        show(graph.to_json_document(nodes, edges))
    else:
        lines({"dot": graph.to_dot, "mermaid": graph.to_mermaid, "stats": graph.graph_report}[a.format](nodes, edges), ["ord"])


def _dependencies(files: DataFrame) -> DataFrame:
    """(path, dep_path): the copybooks that COBOL sources name, by file name in any case."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/]*)$", 1))
    books = parsers.book_dependencies(parsers.parse(files.filter(F.lower("path").rlike(r"\.(cbl|cob|cpy)$")), "cobol"))
    return books.select("path", F.lower("book").alias("_b")).join(files.select(F.col("path").alias("dep_path"), base("path").alias("_b")), "_b").select("path", "dep_path")


def incremental(spark: SparkSession, a: argparse.Namespace) -> None:
    """Which sources are new, changed, deleted or unchanged since the state; the new state."""
    if a.action == "reset":
        versions.write(spark.createDataFrame([], STATE), a.state)
        return
    before = versions.latest(spark, a.state, STATE)
    if a.action == "status":
        show(before.agg(F.count("*").alias("files")))
        return
    files = io.source_files(spark, a.path, a.ext, relative=True)
    now = fingerprint.fingerprints(files, _dependencies(files))
    classes = fingerprint.classify(now, None if before.isEmpty() else before, a.force)
    lines(review.incremental_report(classes), ["part", "line"])
    if not a.dry:
        versions.write(now, a.state)


def snapshot(spark: SparkSession, a: argparse.Namespace) -> None:
    """Lists, shows, tags, deletes, compares and restores the snapshots of a store."""
    store = snapshots.Store(spark, a.root)
    need = {"list": 0, "show": 1, "tag": 2, "delete": 1, "diff": 2, "restore": 2}[a.action]
    if len(a.args) != need:
        sys.exit(f"snapshot {a.action} takes {need} arguments")
    if a.action == "list":
        show(snapshots.summaries(store.table("index")))
    elif a.action == "show":
        show(store.load(*a.args))
        show(store.table("manifests").filter(F.col("snapshot_id") == a.args[0]), ["ord"])
    elif a.action == "tag":
        store.tag(*a.args)
    elif a.action == "delete":
        store.load(*a.args)
        store.delete(*a.args, objects=True)
    elif a.action == "diff":
        for part in store.diff(*a.args).values():
            show(part)
    else:
        store.restore(*a.args)


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Judges metric rows (JSON lines) by the library's gates; 1 if one that counts failed."""
    schema = "run string, compiled boolean, score double, fixtures_passed long, fixtures_total long, functions_matched long, functions_total long, tokens long, errors long"
    metrics = spark.read.schema(schema).json(a.metrics)
    results = gates.evaluate(metrics, "run", gates.from_config(gates.Config(score=a.score, max_tokens=a.tokens)))
    lines(review.gates_report(results, "run"), ["run", "ord"])
    return int(not gates.overall(results, "run").filter("not overall").isEmpty())


def packs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Proof packs below folders, newest first, and their figures."""
    found = io.proof_packs(spark, *a.roots)
    show(gates.packs_in_order(found.drop("results")))
    show(gates.pack_kpis(found))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser("plumbline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *given):
        p = sub.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for flags, options in given:
            p.add_argument(*flags, **options)

    ext = (["--ext"], {"action": "append", "help": "file extension, once for each"})
    command("parse", parse, (["language"], {"choices": sorted(parsers.PARSERS)}), (["path"], {}), ext, (["--out"], {}))
    command("depgraph", depgraph, (["ir"], {}), (["--format"], {"choices": ["stats", "dot", "mermaid", "json"], "default": "stats"}))
    command("incremental", incremental, (["action"], {"choices": ["analyze", "status", "reset"]}), (["state"], {}), (["path"], {"nargs": "?", "default": "."}), ext, (["--force"], {"action": "store_true"}), (["--dry"], {"action": "store_true"}))
    command("snapshot", snapshot, (["root"], {}), (["action"], {"choices": ["list", "show", "tag", "delete", "diff", "restore"]}), (["args"], {"nargs": "*"}))
    command("gate", gate, (["metrics"], {}), (["--score"], {"type": float, "default": 0.8}), (["--tokens"], {"type": int, "default": 0}))
    command("packs", packs, (["roots"], {"nargs": "+"}))
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    return a.run(SparkSession.builder.appName("plumbline").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
