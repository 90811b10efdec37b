"""Queries over parsed sources: files made from ``part``, whose records the SQL derives from the
same rows by what each line of the sources means."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import copybooks, diff, parsers, review, windows
from plumbline.plans import samples

from .registry import query, read


@query()
def line_diff(spark, d):
    """Each document against the one before it of its source; a null text has no lines but one empty."""
    docs = read(spark, d, "documents")
    p = windows.previous(docs.select("source", "doc_id"), "source", "doc_id", "before")
    p = p.join(docs.select("doc_id", F.col("text").alias("new")), "doc_id").join(docs.select(F.col("doc_id").alias("before"), F.col("text").alias("old")), "before")
    return diff.line_diff(p, "doc_id")


PART = "p AS (SELECT p_partkey AS k, p_partkey // 2 AS u, p_size AS s, replace(p_brand, '#', '-') AS b, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS nr FROM part)"


def _records(rows: str) -> str:
    """SQL of records for each part, one a line: record, name, parent, detail with {} for columns."""
    text = lambda x: "''" if not x else " || ".join(f"CAST({y[1:-1]} AS VARCHAR)" if y.startswith("{") else f"'{y}'" for y in _split(x))
    return ", ".join("(" + ", ".join(text(x.strip()) for x in line.split("|")) + ")" for line in rows.strip().split("\n"))


def _split(x: str) -> list[str]:
    import re

    return [y for y in re.split(r"(\{[^}]*\})", x) if y]


def _sql(path: str, rows: str, where: str = "true") -> str:
    return f"SELECT {path} AS path, r.* FROM p, LATERAL (VALUES {_records(rows)}) AS r(record, name, parent, detail) WHERE {where}"


COBOL_PATH, PERL_PATH, FORTRAN_PATH = "'src/p' || k || '.cbl'", "'lib/P' || k || '.pm'", "'src/m' || k || '.f90'"
COBOL = """module|PROG{k}||cobol
data_type|REC-{k}||struct(0,0)
data_type|NAME-{k}|REC-{k}|string({s},0)
data_type|PRICE-{k}|REC-{k}|decimal({s + 2},2)
data_type|TAGS-{k}|REC-{k}|array<integer>x{s}(2,0)
data_type|NOTE-{k}||string(9,0)
data_type|SET-{k}|NOTE-{k}|boolean(0,0)
function|MAIN-{k}|PROG{k}|paragraph
io||MAIN-{k}|display:write
io|IN-{k}|MAIN-{k}|open:read
io|AUX-{k}|MAIN-{k}|open:read
io|OUT-{k}|MAIN-{k}|open:write
call|STEP-{k}|MAIN-{k}|perform
call|LAST-{k}|MAIN-{k}|goto
call|PROG{u}|MAIN-{k}|call
io|INSERT|MAIN-{k}|sql:write
function|STEP-{k}|PROG{k}|paragraph
io|IN-{k}|STEP-{k}|read:read
function|LAST-{k}|PROG{k}|paragraph
io|IN-{k}|LAST-{k}|close:readwrite
io|AUX-{k}|LAST-{k}|close:readwrite
io|OUT-{k}|LAST-{k}|close:readwrite"""
COPIED = "dependency|{upper(b)}|PROG{k}|copy"
BOOK = """data_type|P{k}-BOOK||struct(0,0)
data_type|P{k}-SIZE|P{k}-BOOK|integer(4,0)"""
PERL = """module|Lib::P{k}||perl
dependency|Moose|Lib::P{k}|oop
dependency|Lib::P{u}|Lib::P{k}|use
data_type|size|Lib::P{k}|attribute
function|total|Lib::P{k}|sub
parameter|self|total|unknown
parameter|rate|total|unknown
variable|text|total|string
variable|doc|total|string
call|tail|total|function
call|helper|total|function
call|size|total|method
function|one|Lib::P{k}|sub
call|first|one|function
function|keep|Lib::P{k}|sub
parameter|self|keep|unknown
variable|self|keep|string
variable|fh|keep|string
io|$fh|keep|open:write
function|check|keep|closure
variable|check|keep|string
call|valid|keep|function
io|$fh|keep|close:readwrite
call|final||function"""
FORTRAN = """module|m{k}||module
variable|base{k}|m{k}|real scalar
data_type|pt{k}|m{k}|type
field|x|pt{k}|integer scalar
field|y|pt{k}|integer array
function|area{k}|m{k}|function
parameter|p|area{k}|unknown
parameter|q|area{k}|unknown
variable|p|area{k}|type(pt{k}) scalar in
variable|q|area{k}|real array
variable|r|area{k}|real scalar
call|log_it|area{k}|call
call|keep{u}|area{k}|call
io|print|area{k}|io"""
USED = [(0, "dependency|m{u}|m{k}|use"), (1, "dependency|m{u}|m{k}|use only\nimport|near{k}|m{k}|m{u}:base{u}\nimport|pt{u}|m{k}|m{u}:pt{u}"), (2, "dependency|m{u}|m{k}|use\nimport|away{k}|m{k}|m{u}:base{u}")]
FORTRAN_SQL = " UNION ALL ".join([_sql(FORTRAN_PATH, FORTRAN), *[_sql(FORTRAN_PATH, rows, f"k > 0 AND k % 3 = {m}") for m, rows in USED]])


def parsed(spark, d, language):
    return parsers.parse(samples.files(spark, d, language), language).drop("ord")


@query(f"WITH {PART} {_sql(COBOL_PATH, COBOL)} UNION ALL {_sql(COBOL_PATH, COPIED)}")
def cobol_ir(spark, d):
    """Programs numbered in columns 1 to 6 and 73 to 80, items over two lines and two on one, statements
    behind paragraph names, periods and verbs in literals."""
    return parsed(spark, d, "cobol")


@query(f"WITH {PART} {_sql(PERL_PATH, PERL)}")
def perl_ir(spark, d):
    """Packages with braces in literals, patterns, comments and here documents, and one-line subs."""
    return parsed(spark, d, "perl")


@query(f"WITH {PART} {FORTRAN_SQL}")
def fortran_ir(spark, d):
    """Modules with derived types, ONLY lists, renamings and several statements on a line."""
    return parsed(spark, d, "fortran")


def _expanded(spark, d):
    return copybooks.expand(samples.files(spark, d, "cobol"), copybooks.library(samples.books(spark, d)))


@query(f"WITH {PART} {_sql(COBOL_PATH, COBOL)} UNION ALL {_sql(COBOL_PATH, BOOK, 'nr % 3 <> 0')}")
def cobol_expanded(spark, d):
    """Sources with their copybooks, parsed."""
    return parsers.parse(_expanded(spark, d)[0], "cobol").drop("ord")


@query(f"WITH {PART} SELECT {COBOL_PATH} AS path, upper(b) AS book, 'copybook is not found' AS warning FROM p WHERE nr % 3 = 0")
def copybook_warnings(spark, d):
    return _expanded(spark, d)[1]


@query(f"WITH {PART} SELECT {COBOL_PATH} AS path, 'MAIN-' || k AS \"function\", CAST(0 AS BIGINT) AS exec_cics, CAST(1 AS BIGINT) AS exec_sql, CAST(1 AS BIGINT) AS evaluate, CAST(1 AS BIGINT) AS \"when\", CAST(1 AS BIGINT) AS goto FROM p")
def cobol_constructs(spark, d):
    return parsers.construct_counts(parsers.parse(samples.files(spark, d, "cobol"), "cobol_constructs"))


@query(f"WITH {PART} SELECT {FORTRAN_PATH} AS path, 'm' || k AS unit, 'm' || u AS module, 'base' || u AS name FROM p WHERE k > 0 AND u IN (SELECT k FROM p)")
def fortran_imports(spark, d):
    return parsers.imported(parsers.parse(samples.files(spark, d, "fortran"), "fortran"))


@query(f"""WITH RECURSIVE {PART}, v AS (SELECT k, r.*, 'M' || k AS module, name AS original, false AS used FROM p, LATERAL (VALUES ('BASE' || k, 'variable'), ('PT' || k, 'data_type'), ('AREA' || k, 'function')) AS r(name, kind)
 UNION SELECT p.k, CASE WHEN v.name <> 'BASE' || p.u OR p.k % 3 = 0 THEN v.name WHEN p.k % 3 = 1 THEN 'NEAR' || p.k ELSE 'AWAY' || p.k END, v.kind, v.module, v.original, true
 FROM v JOIN p ON p.u = v.k WHERE p.k > 0 AND (p.k % 3 <> 1 OR v.name IN ('BASE' || p.u, 'PT' || p.u)))
 SELECT 'M' || k AS unit, name, module, original, kind FROM v WHERE used""")
def fortran_scopes(spark, d):
    """What each module gets by USE over any chain of modules."""
    return parsers.scopes(parsers.parse(samples.files(spark, d, "fortran"), "fortran"))


@query(f"""WITH {PART} SELECT {FORTRAN_PATH} AS path, 'area' || k AS "function", r.* FROM p, LATERAL (VALUES ('p', 'type(pt' || k || ') scalar in'), ('q', 'real array')) AS r(name, type)""")
def fortran_parameters(spark, d):
    return parsers.typed_parameters(parsers.parse(samples.files(spark, d, "fortran"), "fortran")).drop("ord")


@query(f"WITH {PART} SELECT {COBOL_PATH} AS path, upper(b) || '.cpy' AS book FROM p")
def cobol_books(spark, d):
    return parsers.book_dependencies(parsers.parse(samples.files(spark, d, "cobol"), "cobol"))


def _text(template: str) -> str:
    quoted = "'" + template.replace("'", "''") + "'"
    for name in "kus":
        quoted = f"replace({quoted}, '{{{name}}}', CAST({name} AS VARCHAR))"
    return quoted


_USE = "CASE WHEN k = 0 THEN '' " + " ".join(f"WHEN k % 3 = {i} THEN {_text(x)}" for i, x in enumerate(samples.USES)) + " END"
_BYTES = {"cobol": str(81 * samples.COBOL.count("\n") + 80), "perl": f"strlen({_text(samples.PERL)})", "fortran": f"strlen({_text(samples.FORTRAN.replace('{use}', ''))}) + strlen({_USE})"}
_COUNTS = ", ".join(f"CAST(count(*) FILTER (record = '{r}') AS BIGINT) AS {n}" for r, n in (("module", "modules"), ("function", "functions"), ("data_type", "data_types"), ("io", "io"), ("call", "calls")))
_METRICS = [f"SELECT (SELECT count(*) FROM p) AS files, (SELECT CAST(sum({_BYTES[k]}) AS BIGINT) FROM p) AS bytes, {_COUNTS}, '{k}' AS language FROM ({sql})" for k, sql in (("cobol", _sql(COBOL_PATH, COBOL)), ("perl", _sql(PERL_PATH, PERL)), ("fortran", _sql(FORTRAN_PATH, FORTRAN)))]


@query(f"WITH {PART} {' UNION ALL '.join(_METRICS)}")
def source_metrics(spark, d):
    one = lambda k: review.source_metrics(samples.files(spark, d, k), parsers.parse(samples.files(spark, d, k), k)).withColumn("language", F.lit(k))
    return one("cobol").unionByName(one("perl")).unionByName(one("fortran"))
