"""Readers and writers: source files, fixtures, state, object store, audit, exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import versions

FIXTURE = "kind string, name string, correlation_id string, http struct<method:string,path:string,header:map<string,string>,body:string,expected_status:int,expected_header:map<string,string>,expected_body:string>, expected_status int, expected_header map<string,string>, expected_body string, _bad string"


def extensions(names: list[str] | None) -> list[str]:
    """Trimmed, lower case, with a dot; COBOL's where none are named."""
    return sorted({"." + n.strip().lower().lstrip(".") for n in names or ["cbl", "cob", "cpy"] if n.strip()})


def source_files(spark: SparkSession, path: str, names: list[str] | None = None, relative: bool = False, recursive: bool = True) -> DataFrame:
    """Files under a folder by extension: path, content, size; paths from the folder on where
    they are to be ``relative``."""
    ext = extensions(names)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    shown = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^file:/*", "/")
    root = path.removeprefix("file://").rstrip("/") + "/"
    shown = F.when(shown.startswith(root), F.substr(shown, F.lit(len(root) + 1))).otherwise(shown) if relative else F.col("path")
    return df.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(ext)).select(shown.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


#: Where copybooks lie beside a source folder.
BOOK_FOLDERS = (".", "../cpy", "../copy", "cpy", "copy")


def sibling_books(spark: SparkSession, path: str, folders: tuple[str, ...] = BOOK_FOLDERS) -> DataFrame:
    """(path, content, size) of the copybooks in the folders beside ``path`` that there are, each
    path once."""
    import posixpath

    jvm, found = spark._jvm, []
    for f in dict.fromkeys(posixpath.normpath(posixpath.join(path, x)) for x in folders):
        p = jvm.org.apache.hadoop.fs.Path(f)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append(source_files(spark, f, ["cpy"], recursive=False))
    if not found:
        return spark.createDataFrame([], "path string, content string, size long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path"])


def jdbc_table(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, order: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """A database's table by its (checked) name; a cap needs an order, so that it is the same
    rows each time."""
    import re

    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", table):
        raise ValueError(f"{table!r} is no identifier")
    if cap is not None and not order:
        raise ValueError("a cap needs an order")
    df = spark.read.jdbc(url, f'"{table}"', properties=properties or {})
    return df if cap is None else df.orderBy(*order).limit(cap)


def file_count(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").count()


def fixtures(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """JSONL fixtures; expectations at the top level or under http; a bad line, or one without
    kind or name, fails with its file and split (the byte where that begins), or where they are
    to be ``numbered`` with its line; then each file is read whole by one task."""
    if numbered:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.posexplode(F.split("value", "\n")).alias("i", "value"))
        lines = whole.select("value", F.concat_ws(":", "f", (F.col("i") + 1).cast("string")).alias("_at"))
    else:
        lines = spark.read.text(path).select("value", F.concat_ws(":", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string")).alias("_at"))
    lines = lines.filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", FIXTURE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("f"), "value", "_at")
    why = F.when(F.col("f._bad").isNotNull() | F.col("f").isNull(), "is no JSON").when(F.coalesce("f.kind", F.lit("")) == "", "has no kind").when(F.coalesce("f.name", F.lit("")) == "", "has no name")
    checked = F.when(why.isNull(), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("fixture line "), why, F.lit(" in "), F.coalesce("_at", F.lit("?")), F.lit(": "), F.left("value", F.lit(80)))))
    f = rows.select(checked.alias("f"))
    pick = lambda c: F.coalesce(f"f.http.{c}", f"f.{c}").alias(c)
    return f.select("f.kind", "f.name", "f.correlation_id", "f.http", pick("expected_status"), pick("expected_header"), pick("expected_body"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved state, or an empty one where none is; one that cannot be read fails."""
    return versions.latest(spark, path, schema)


def save_state(df: DataFrame, path: str) -> None:
    """A new version of the state; readers of the one before keep it."""
    versions.write(df, path)


TYPE = "struct<name:string,kind:string,size:int,scale:int>"
IR = f"modules array<struct<name:string,path:string,language:string,metadata:map<string,string>,functions:array<struct<name:string,body:string,calls:array<string>,parameters:array<struct<name:string,type:{TYPE},optional:boolean>>>>,data_types:array<{TYPE}>,io_contracts:array<struct<name:string,kind:string,direction:string>>>>, call_graph struct<edges:array<struct<caller:string,callee:string>>>, business_rules array<struct<id:string,description:string,source_ref:string,confidence:double,tags:array<string>>>, metadata map<string,string>"


def ir_documents(spark: SparkSession, path: str) -> DataFrame:
    """Semantic graphs as JSON documents: graph_id (the file), and the columns of IR."""
    return spark.read.schema(IR).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("graph_id"), "*")


def ir_tables(graphs: DataFrame) -> dict[str, DataFrame]:
    """The normalized tables of semantic graphs: modules, functions, data_types, io, calls, rules."""
    m = graphs.select("graph_id", F.posexplode("modules").alias("ord", "m"))
    of = lambda field: m.select("graph_id", "ord", F.col("m.name").alias("module"), F.posexplode(f"m.{field}").alias("at", "x"))
    return {
        "modules": m.select("graph_id", "ord", "m.name", "m.path", "m.language", "m.metadata"),
        "functions": of("functions").select("graph_id", "ord", "module", "at", "x.name", "x.body", F.coalesce("x.calls", F.array().cast("array<string>")).alias("calls"), "x.parameters"),
        "data_types": of("data_types").select("graph_id", "ord", "module", "at", "x.*"),
        "io": of("io_contracts").select("graph_id", "ord", "module", "at", "x.*"),
        "calls": graphs.select("graph_id", F.explode("call_graph.edges").alias("e")).select("graph_id", "e.caller", "e.callee"),
        "rules": graphs.select("graph_id", F.explode("business_rules").alias("r")).select("graph_id", "r.*"),
    }


def module_books(modules: DataFrame) -> DataFrame:
    """(path, dependency): what the metadata of modules (path, metadata) names: ``copy_refs`` as
    they are, ``copybooks_resolved`` as .cpy files; names are split at commas and trimmed."""
    split = lambda k: F.filter(F.transform(F.split(F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    every = F.concat(split("copy_refs"), F.transform(split("copybooks_resolved"), lambda x: F.concat(x, F.lit(".cpy"))))
    return modules.select("path", F.explode(every).alias("dependency"))


def write_pack(results: DataFrame, folder: str, started_at: Column, ended_at: Column) -> None:
    """A proof pack's summary.json (one JSON row) from results (name, kind, correlation_id, pass,
    diff_kind, reason): counts, whether all passed, and the results in order of name. A pack is one
    document, so its results meet in one task."""
    diff = F.struct(F.col("pass"), F.col("diff_kind").alias("kind"), "reason")
    row = F.struct("name", "kind", "correlation_id", diff.alias("diff"))
    n = F.count("name")
    made = results.agg(F.count_if(F.col("pass")).alias("_ok"), n.alias("_n"), F.array_sort(F.collect_list(row)).alias("results"))
    doc = F.struct((F.col("_ok") == F.col("_n")).alias("pass"), F.col("_n").alias("fixture_count"), F.col("_ok").alias("pass_count"), (F.col("_n") - F.col("_ok")).alias("fail_count"), started_at.cast("timestamp").alias("started_at"), ended_at.cast("timestamp").alias("ended_at"), "results")
    versions.write_files(made.select(F.lit("summary.json").alias("path"), F.to_json(doc).alias("content")), folder)


PACK = "pass boolean, fixture_count long, pass_count long, fail_count long, started_at timestamp, ended_at timestamp, results array<struct<name:string,kind:string,correlation_id:string,diff:struct<pass:boolean,kind:string,reason:string>>>, _bad string"


def proof_packs(spark: SparkSession, *roots: str) -> DataFrame:
    """Every summary.json below the roots, a row each, newest first by ``started_at`` when
    sorted; bad ones are left out. The id is the start of the hash of the pack's folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").text(list(roots), wholetext=True)
    folder = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"^file:/*", "/")), "/[^/]*$", "")
    rows = raw.select(folder.alias("dir"), F.from_json("value", PACK, {"columnNameOfCorruptRecord": "_bad"}).alias("p")).filter("p is not null and p._bad is null")
    millis = (F.unix_millis("p.ended_at") - F.unix_millis("p.started_at")).alias("millis")
    return rows.select(F.substring(F.sha2(F.col("dir").cast("binary"), 256), 1, 16).alias("id"), "dir", "p.pass", "p.fixture_count", "p.pass_count", "p.fail_count", "p.started_at", "p.ended_at", millis, "p.results")


def pack_fixtures(packs: DataFrame) -> DataFrame:
    """A row for each result of each pack."""
    r = packs.select("id", F.explode("results").alias("r"))
    return r.select("id", "r.name", "r.kind", "r.correlation_id", F.col("r.diff.pass").alias("pass"), F.col("r.diff.kind").alias("diff_kind"), F.col("r.diff.reason").alias("diff_reason"))


def put_objects(objects: DataFrame, path: str) -> None:
    """Appends content-addressed objects, a folder for each prefix."""
    objects.write.mode("append").partitionBy("prefix").parquet(path)


def append_audit(df: DataFrame, path: str, session: str, user: str) -> None:
    """Appends events as JSON lines; time, session and user are filled where they are null."""
    filled = df.withColumns({"ts": F.coalesce("ts", F.current_timestamp()), "session_id": F.coalesce("session_id", F.lit(session)), "user": F.coalesce("user", F.lit(user))})
    filled.write.mode("append").json(path)


def sbom(files: DataFrame, name: str, runtime: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows (ord, json) of a CycloneDX document: its head, then a component each for files (path,
    content) with their hash and for runtime dependencies (name, version). A document of any
    size is so written by many tasks; ``sbom_document`` makes one text of it."""
    spark = files.sparkSession
    head = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.struct(F.struct(F.lit("application").alias("type"), F.lit(name).alias("name")).alias("component")).alias("metadata"))
    hashes = F.array(F.struct(F.lit("SHA-256").alias("alg"), F.sha2(F.col("content").cast("binary"), 256).alias("content")))
    component = F.struct(F.lit("file").alias("type"), F.col("path").alias("name"), hashes.alias("hashes"))
    at = lambda part, key: F.struct(F.lit(part).alias("part"), key.alias("name"))
    out = spark.range(1).select(at(0, F.lit("")).alias("ord"), F.to_json(head).alias("json")).unionByName(files.select(at(1, F.col("path")).alias("ord"), F.to_json(component).alias("json")))
    if runtime:
        deps = spark.createDataFrame(list(runtime), "name string, version string")
        out = out.unionByName(deps.select(at(2, F.col("name")).alias("ord"), F.to_json(F.struct(F.lit("library").alias("type"), "name", "version")).alias("json")))
    return out


def sbom_document(rows: DataFrame) -> DataFrame:
    """One text of the rows of ``sbom``, for documents that fit one task."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"])
    whole = rows.agg(parts.alias("p"))
    head = F.get("p", F.lit(0))
    return whole.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"components":['), F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), ","), F.lit("]}")).alias("sbom"))
