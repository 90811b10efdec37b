"""Queries over snapshots and over call graphs and their store."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import codegen, cycles, graph, parsers, snapshots, storage

from .registry import query, read

# ---- snapshots ------------------------------------------------------------------------


def files(spark, d):
    """Documents as a snapshot's files, in order of doc_id."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "source")


@query("""SELECT source AS snapshot_id, sha256(string_agg('doc/' || doc_id || sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS content_hash, count(*) AS file_count FROM documents GROUP BY source""")
def snapshot_hashes(spark, d):
    return snapshots.manifest_hash(snapshots.manifest(files(spark, d), F.col("source")))


@query("""SELECT doc_id AS ord, 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents""")
def snapshot_manifest(spark, d):
    return snapshots.manifest(files(spark, d), F.lit("one")).drop("snapshot_id")


@query("""SELECT l_suppkey AS snapshot_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls, CAST(sum(l_linenumber + l_partkey) AS BIGINT) AS tokens, CAST(sum(l_orderkey) AS BIGINT) AS duration_ms, greatest(max(l_discount - 0.05), CAST(0 AS DOUBLE)) AS score FROM lineitem GROUP BY 1""")
def snapshot_provenance(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_quantity").cast("long").alias("calls"), F.col("l_linenumber").alias("prompt_tokens"), F.col("l_partkey").alias("completion_tokens"), F.col("l_orderkey").alias("duration_ms"), (F.col("l_discount") - 0.05).alias("score"))
    return snapshots.provenance(s)


INDEX = """i AS (SELECT substr(sha256('{"t":' || (epoch_us(o_orderdate) * 1000) || ',"c":"' || o_orderkey || '"}'), 1, 16) AS id, o_orderpriority AS tag, o_orderstatus AS status, epoch_us(o_orderdate) AS us, CAST(o_custkey AS BIGINT) AS file_count FROM orders)"""


def order_index(spark, d):
    """Orders as the rows of a snapshot index."""
    o = read(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    none = lambda n: F.lit(None).cast("string").alias(n)
    return o.select(snapshots.snapshot_id(at, F.col("o_orderkey").cast("string")).alias("id"), none("parent_id"), F.col("o_orderpriority").alias("tag"), at.alias("created_at"), F.lit("cobol").alias("source_lang"), F.lit("java").alias("target_lang"), F.lit(1.0).alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("file_count"))


@query(f"WITH {INDEX} SELECT id, CASE WHEN id < '8' THEN 'old' ELSE tag END AS tag, status, us, file_count FROM i WHERE id NOT LIKE 'f%'")
def snapshot_list(spark, d):
    """Tags changed, snapshots left out, listed newest first."""
    i = order_index(spark, d)
    i = i.filter(~F.col("id").startswith("f")).withColumn("tag", F.when(F.col("id") < "8", "old").otherwise(F.col("tag")))
    return snapshots.summaries(i).select("id", "tag", "status", F.unix_micros("created_at").alias("us"), "file_count")


@query(f"WITH {INDEX} SELECT id FROM i WHERE tag = '1-URGENT' ORDER BY us, id LIMIT 1")
def snapshot_by_tag(spark, d):
    return snapshots.by_tag(order_index(spark, d), "1-URGENT").select("id")


MOVED = """o AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS h, doc_id FROM documents),
 n AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'moved/' || doc_id ELSE path END AS path, CASE WHEN doc_id % 10 = 0 THEN h || 'x' ELSE h END AS h FROM o WHERE doc_id % 14 <> 0),
 j AS (SELECT coalesce(o.path, n.path) AS path, o.h AS was, n.h AS now, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path),
 g AS (SELECT path, was, row_number() OVER (PARTITION BY was ORDER BY path) AS r FROM j WHERE change = 'removed'),
 c AS (SELECT path, now, row_number() OVER (PARTITION BY now ORDER BY path) AS r FROM j WHERE change = 'added'),
 m AS (SELECT c.path, g.path AS renamed_from FROM c LEFT JOIN g ON c.now = g.was AND c.r = g.r)"""


@query(f"""WITH {MOVED} SELECT path, CASE WHEN renamed_from IS NULL THEN 'added' ELSE 'renamed' END AS change, renamed_from FROM m
 UNION ALL SELECT path, change, NULL FROM j WHERE change IN ('modified', 'removed') AND path NOT IN (SELECT renamed_from FROM m WHERE renamed_from IS NOT NULL)""")
def snapshot_changes(spark, d):
    old = snapshots.manifest(files(spark, d), F.lit("old")).select("ord", "path", "content_hash")
    new = old.filter(F.col("ord") % 14 != 0).select(F.when(F.col("ord") % 9 == 0, F.regexp_replace("path", "^doc", "moved")).otherwise(F.col("path")).alias("path"), F.when(F.col("ord") % 10 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    return snapshots.compared(old, new)


@query("""SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS content_sha256, 'kept' AS tag FROM documents""")
def snapshot_store(spark, d):
    """All documents saved as a snapshot, saved again as another (no object twice), the first
    deleted, the second tagged, found by its tag and read back."""
    store = snapshots.Store(spark, storage.scratch(spark))
    stage = spark.createDataFrame([(0, "judge", "success", 0.9, 10, 1, 2, 3, 0)], "ord long, name string, status string, score double, duration_ms long, calls long, prompt_tokens long, completion_tokens long, errors long")
    described = lambda at: spark.sql(f"SELECT timestamp '{at}' AS created_at, 'cobol' AS source_lang, 'java' AS target_lang, 'success' AS status")
    f = files(spark, d).select("ord", "path", "content")
    first = store.save(described("2024-01-01 00:00:00"), f, stage)
    second = store.save(described("2024-01-02 00:00:00"), f, stage)
    store.tag(second, "kept")
    store.delete(first, objects=True)
    found = store.find("kept").first()
    return store.files(found["id"]).select("path", S.sha256(F.col("content")).alias("content_sha256"), F.lit(found["tag"]).alias("tag"))


# ---- call graphs ----------------------------------------------------------------------

CALLS = """fn AS (SELECT DISTINCT p_brand AS module, CAST(substr(p_brand, 7) AS BIGINT) AS ord, replace(p_name, ' ', '-') AS name FROM part),
 c AS (SELECT DISTINCT a.p_brand AS module, replace(a.p_name, ' ', '-') AS name, CASE WHEN a.p_size % 10 = 0 THEN 'ghost-' || a.p_size ELSE replace(b.p_name, ' ', '-') END AS callee FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 1) % (SELECT count(*) FROM part)),
 f AS (SELECT name, arg_min('fn:' || module || '.' || name, ord) AS id FROM fn GROUP BY name),
 calls AS (SELECT 'fn:' || module || '.' || c.name AS src, coalesce(f.id, 'fn:' || module || '.' || callee) AS dst, 'calls' AS kind FROM c LEFT JOIN f ON f.name = callee),
 owns AS (SELECT 'mod:' || module AS src, 'fn:' || module || '.' || name AS dst, 'contains' AS kind FROM fn)"""


def functions(spark, d):
    """Parts as functions (module, ord, name, calls): a brand is a module; a part calls another
    part's name, or one that no module has."""
    p = read(spark, d, "part")
    n = p.count()
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    a = p.select(F.col("p_brand").alias("module"), name.alias("name"), ((F.col("p_partkey") * 7 + 1) % n).alias("_k"), "p_size")
    b = p.select(F.col("p_partkey").alias("_k"), name.alias("_to"))
    callee = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("ghost-"), F.col("p_size").cast("string"))).otherwise(F.col("_to"))
    made = a.join(b, "_k").groupBy("module", "name").agg(F.collect_set(callee).alias("calls"))
    return made.withColumn("ord", F.substr("module", F.lit(7)).cast("long"))


def call_graph(spark, d):
    f = functions(spark, d)
    none = spark.createDataFrame([], "module string, name string")
    return f, *graph.build(f, none, none)


@query(f"WITH {CALLS} SELECT * FROM calls UNION ALL SELECT * FROM owns")
def graph_call_edges(spark, d):
    return call_graph(spark, d)[2]


@query(f"""WITH {CALLS}, e AS (SELECT DISTINCT dst FROM calls) SELECT DISTINCT id, kind, name, module FROM (SELECT 'mod:' || module AS id, 'module' AS kind, module AS name, module FROM fn
 UNION ALL SELECT 'fn:' || module || '.' || name, 'function', name, module FROM fn UNION ALL SELECT dst, 'function', regexp_extract(dst, '^fn:[^.]*\\.(.*)$', 1), regexp_extract(dst, '^fn:([^.]*)', 1) FROM e)""")
def graph_nodes(spark, d):
    return call_graph(spark, d)[1]


@query("""SELECT DISTINCT 'fn:' || arg_min(b.p_brand, CAST(substr(b.p_brand, 7) AS BIGINT)) || '.' || replace(a.p_name, ' ', '-') AS dst FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY a.p_name""")
def resolve_names(spark, d):
    """Each name's function, of the first module in order."""
    return graph.first_functions(functions(spark, d)).select(F.col("id").alias("dst"))


MORE = "m AS (SELECT DISTINCT replace(p_name, ' ', '-') AS caller, CASE WHEN p_partkey % 3 = 0 THEN 'lost' ELSE reverse(replace(p_name, ' ', '-')) END AS callee FROM part)"


@query(f"""WITH {CALLS}, {MORE}, g AS (SELECT DISTINCT coalesce(a.id, 'fn:unknown.' || caller) AS src, coalesce(b.id, 'fn:unknown.' || callee) AS dst, 'calls' AS kind FROM m LEFT JOIN f a ON a.name = caller LEFT JOIN f b ON b.name = callee)
 SELECT * FROM calls UNION ALL SELECT * FROM owns UNION ALL (SELECT * FROM g EXCEPT SELECT * FROM calls)""")
def graph_merged_calls(spark, d):
    f, _, edges = call_graph(spark, d)
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    more = read(spark, d, "part").select(name.alias("caller"), F.when(F.col("p_partkey") % 3 == 0, "lost").otherwise(F.reverse(name)).alias("callee")).distinct()
    return graph.merge_calls(edges, f, more)


DEPENDS = "dep AS (SELECT DISTINCT regexp_extract(src, '^fn:([^.]*)', 1) AS a, regexp_extract(dst, '^fn:([^.]*)', 1) AS b FROM calls WHERE regexp_extract(src, '^fn:([^.]*)', 1) <> regexp_extract(dst, '^fn:([^.]*)', 1))"


@query(f"WITH {CALLS}, {DEPENDS} SELECT 'mod:' || a AS src, 'mod:' || b AS dst, 'depends_on' AS kind FROM dep")
def graph_module_edges(spark, d):
    return graph.with_module_edges(call_graph(spark, d)[2]).filter("kind = 'depends_on'")


NODES = """n AS (SELECT DISTINCT id, kind, module FROM (SELECT 'mod:' || module AS id, 'module' AS kind, module FROM fn UNION ALL SELECT 'fn:' || module || '.' || name, 'function', module FROM fn UNION ALL SELECT dst, 'function', regexp_extract(dst, '^fn:([^.]*)', 1) FROM calls))"""


@query(f"""WITH {CALLS}, {DEPENDS}, {NODES}, o AS (SELECT a, count(*) AS k FROM dep GROUP BY a)
 SELECT module, count(*) FILTER (kind = 'module') AS n_module, count(*) FILTER (kind = 'function') AS n_function, CAST(0 AS BIGINT) AS n_data_type, CAST(0 AS BIGINT) AS n_io, coalesce(max(k), 0) AS fan_out FROM n LEFT JOIN o ON o.a = module GROUP BY module""")
def graph_module_stats(spark, d):
    _, nodes, edges = call_graph(spark, d)
    return graph.module_stats(nodes, edges)


@query(f"""WITH {CALLS}, {NODES}, e AS (SELECT * FROM calls UNION ALL SELECT * FROM owns), x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), g AS (SELECT id, sum(o) AS o, sum(i) AS i FROM x GROUP BY id)
 SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM n WHERE kind = 'module') AS n_module, (SELECT count(*) FROM n WHERE kind = 'function') AS n_function, CAST(0 AS BIGINT) AS n_data_type, CAST(0 AS BIGINT) AS n_io, (SELECT count(*) FROM e) AS n_edges,
 CAST(max(o) AS BIGINT) AS max_fan_out, CAST(max(i) AS BIGINT) AS max_fan_in, (SELECT id FROM g ORDER BY o DESC, id LIMIT 1) AS hotspot FROM g""")
def graph_kind_stats(spark, d):
    _, nodes, edges = call_graph(spark, d)
    return graph.stats(nodes, edges)


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
 SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def graph_strong_components(spark, d):
    return cycles.strong_components(call_graph(spark, d)[2].filter("kind = 'calls'"))


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
 sc AS (SELECT a.src AS id, min(a.dst) AS k FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
 i AS (SELECT e.src, e.dst, a.k FROM e JOIN sc a ON a.id = e.src JOIN sc b ON b.id = e.dst WHERE a.k = b.k),
 l AS (SELECT k FROM i WHERE src = k AND dst = k), g AS (SELECT * FROM i WHERE src <> dst AND k NOT IN (SELECT k FROM l)), z AS (SELECT k, count(DISTINCT src) AS n FROM g GROUP BY k),
 w AS (SELECT DISTINCT k, k AS id, 0 AS d FROM g UNION SELECT w.k, g.dst, w.d + 1 FROM w JOIN g ON g.src = w.id JOIN z ON z.k = w.k WHERE w.d < z.n),
 m AS (SELECT k, id, min(d) AS d FROM w GROUP BY k, id),
 p AS (SELECT g.dst AS id, min(g.src) AS prev FROM g JOIN m a ON a.id = g.src JOIN m b ON b.id = g.dst WHERE b.d = a.d + 1 GROUP BY g.dst),
 t AS (SELECT g.k, min(struct_pack(d := m.d, src := g.src)) AS s FROM g JOIN m ON m.id = g.src WHERE g.dst = g.k GROUP BY g.k),
 y AS (SELECT k, s.d AS ord, s.src AS src, k AS dst FROM t UNION ALL SELECT y.k, y.ord - 1, p.prev, y.src FROM y JOIN p ON p.id = y.src WHERE y.src <> y.k)
 SELECT k AS component, CAST(ord AS BIGINT) AS ord, src, dst FROM y UNION ALL SELECT k, 0, k, k FROM l""")
def graph_cycle_paths(spark, d):
    """One shortest cycle through the smallest node of each strong component."""
    return cycles.cycle_paths(call_graph(spark, d)[2].filter("kind = 'calls'"))


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
 s AS (SELECT a.src AS id, min(a.dst) AS k FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
 o AS (SELECT v.id, sha256(reverse(v.id)) AS hash, coalesce(k, v.id) AS k FROM v LEFT JOIN s USING (id)), h AS (SELECT k, sha256(id || ':' || hash) AS x FROM o),
 b AS (SELECT k, sum(CAST('0x' || x[1:15] AS BIGINT)) || '-' || sum(CAST('0x' || x[16:30] AS BIGINT)) || '-' || count(*) AS own FROM h GROUP BY k),
 u AS (SELECT DISTINCT x.k AS a, y.k AS b FROM e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE x.k <> y.k), n AS (SELECT k, own, count(u.a) AS n FROM b LEFT JOIN u ON u.a = b.k GROUP BY k, own),
 tf(k, f, level) USING KEY (k) AS (SELECT k, sha256(own || '|0-0-0'), 0 FROM n WHERE n = 0
  UNION SELECT n.k, sha256(any_value(own) || '|' || sum(CAST('0x' || q.f[1:15] AS BIGINT)) || '-' || sum(CAST('0x' || q.f[16:30] AS BIGINT)) || '-' || count(*)), max(q.level) + 1
   FROM n JOIN u ON u.a = n.k JOIN recurring.tf q ON q.k = u.b WHERE n.k NOT IN (SELECT k FROM recurring.tf) GROUP BY n.k, n.n HAVING count(*) = n.n)
 SELECT id, sha256(id || ':' || hash || '|' || f) AS fingerprint, level FROM o JOIN tf USING (k)""")
def graph_fingerprints(spark, d):
    """Fingerprints of functions that change with anything they call, at any distance."""
    calls = call_graph(spark, d)[2].filter("kind = 'calls'")
    ids = calls.select(F.col("src").alias("id")).union(calls.select("dst")).distinct()
    return cycles.transitive_fingerprints(ids.withColumn("hash", F.sha2(F.reverse("id").cast("binary"), 256)), calls)


@query(f"""WITH {CALLS}, s AS (SELECT DISTINCT name, 'old' AS module FROM fn WHERE length(name) % 2 = 0), u AS (SELECT name, max(module) AS module FROM fn WHERE length(name) % 3 = 0 GROUP BY name)
 SELECT * FROM u UNION ALL SELECT * FROM s WHERE name NOT IN (SELECT name FROM u)""")
def graph_upsert(spark, d):
    f = functions(spark, d).select("name", "module")
    return graph.upsert(f.filter(F.length("name") % 2 == 0).select("name", F.lit("old").alias("module")).distinct(), f.filter(F.length("name") % 3 == 0), ["name"])


@query(f"""WITH {CALLS}, m AS (SELECT DISTINCT module AS name FROM fn UNION SELECT 'Brand#none') SELECT m.name, 'src/' || m.name AS path, 'cobol' AS language, coalesce(string_agg(fn.name, ',' ORDER BY fn.name), '') AS functions FROM m LEFT JOIN fn ON fn.module = m.name GROUP BY m.name""")
def graph_load_modules(spark, d):
    f = functions(spark, d)
    m = f.select(F.col("module").alias("name")).union(spark.sql("SELECT 'Brand#none'")).distinct().select("name", F.concat(F.lit("src/"), "name").alias("path"), F.lit("cobol").alias("language"))
    return graph.load_modules(m, f.select("module", F.col("name").alias("function"))).withColumn("functions", F.array_join("functions", ","))


@query(f"""WITH {CALLS} SELECT '  "' || src || '" -> "' || dst || '" [style=' || CASE kind WHEN 'contains' THEN 'dashed color="#8b949e"' ELSE 'solid color="#3fb950"' END || '];' AS line FROM (SELECT * FROM calls UNION ALL SELECT * FROM owns)""")
def graph_dot(spark, d):
    """The edges of the DOT text."""
    f, nodes, edges = call_graph(spark, d)
    return graph.to_dot(nodes, edges).filter(F.col("line").contains(" -> ")).select("line")


@query(f"WITH {CALLS} SELECT regexp_extract(dst, '^fn:([^.]*)', 1) AS module, dst FROM calls WHERE src = (SELECT min(src) FROM calls)")
def callees_one_hop(spark, d):
    """What one function calls."""
    edges = call_graph(spark, d)[2]
    first = edges.filter("kind = 'calls'").agg(F.min("src").alias("s")).first()["s"]
    return graph.callees(edges, first).select(S.node_module(F.col("dst")).alias("module"), "dst")


# ---- rules and generated files --------------------------------------------------------

RULES = "r AS (SELECT 'rule' || p_partkey AS rule, p_brand || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '.' || replace(p_name, ' ', '-') END || CASE p_partkey % 8 WHEN 7 THEN '.deep' ELSE '' END AS ref FROM part)"


def rules(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, "x").otherwise(F.concat(F.lit("."), F.replace("p_name", F.lit(" "), F.lit("-"))))
    return read(spark, d, "part").select(F.concat(F.lit("rule"), k.cast("string")).alias("rule"), F.concat("p_brand", tail, F.when(k % 8 == 7, ".deep").otherwise("")).alias("ref"))


@query(f"WITH {CALLS}, {RULES} SELECT module, name AS function, rule FROM r JOIN fn ON ref = module || '.' || name")
def rules_of_functions(spark, d):
    return parsers.rule_functions(rules(spark, d), functions(spark, d).select("module", F.col("name").alias("function")))


@query(f"WITH {CALLS}, {RULES}, m AS (SELECT DISTINCT module FROM fn) SELECT module, rule FROM r JOIN m ON ref = module OR starts_with(ref, module || '.')")
def rules_of_modules(spark, d):
    return parsers.rule_modules(rules(spark, d), functions(spark, d))


def generated(spark, d):
    return functions(spark, d).select("module", F.rank().over(_by_name()).cast("long").alias("ord"), F.col("name").alias("function"))


def _by_name():
    from pyspark.sql import Window as W

    return W.partitionBy("module").orderBy("name")


CLEAN = "regexp_replace({0}, '[^A-Za-z0-9_.\\s-]+', '_', 'g')"
PASCAL = "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[-_\\s.]+'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), '')"
SNAKE = "lower(array_to_string(list_filter(regexp_split_to_array({0}, '[-_\\s.]+'), lambda x: x <> ''), '_'))"


MODULE = CLEAN.format("module")


@query(f"""WITH {CALLS} SELECT module, 'generated/' || {SNAKE.format(MODULE)} || '.py' AS path, sha256('class ' || {PASCAL.format(MODULE)} || 'Service:' || chr(10) || string_agg('    def ' || {SNAKE.format('name')} || '(self):' || chr(10) || '        ' || repeat(chr(34), 3) || 'From ' || name || '.' || repeat(chr(34), 3) || chr(10) || '        raise NotImplementedError("' || name || '")' || chr(10) || chr(10), '' ORDER BY name) || '    pass' || chr(10)) AS content FROM fn GROUP BY module""")
def generated_files(spark, d):
    return codegen.generate(generated(spark, d), "python").withColumn("content", S.sha256(F.col("content")))


@query(f"""WITH {CALLS} SELECT module, 'generated/' || {SNAKE.format(MODULE)} || '_test.go' AS path, sha256('package generated' || chr(10) || chr(10) || 'import "testing"' || chr(10) || chr(10) || string_agg('func Test' || {PASCAL.format(MODULE)} || {PASCAL.format('name')} || '(t *testing.T) {{' || chr(10) || chr(9) || 'if err := (&' || {PASCAL.format(MODULE)} || 'Service{{}}).' || {PASCAL.format('name')} || '(); err != ErrUnsupported {{' || chr(10) || chr(9) || chr(9) || 't.Fatal(err)' || chr(10) || chr(9) || '}}' || chr(10) || '}}' || chr(10) || chr(10), '' ORDER BY name)) AS content FROM fn GROUP BY module""")
def generated_tests(spark, d):
    return codegen.generate_tests(generated(spark, d), "go").withColumn("content", S.sha256(F.col("content")))


KIND = "CASE p_size % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'decimal' WHEN 3 THEN 'array<integer>' ELSE 'struct' END"


@query(f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'String' WHEN 1 THEN CASE WHEN p_size > 9 THEN 'long' ELSE 'int' END WHEN 2 THEN 'java.math.BigDecimal'
 WHEN 3 THEN 'java.util.List<' || CASE WHEN p_size > 9 THEN 'long' ELSE 'int' END || '>' ELSE {PASCAL.format('p_name')} END AS java,
 CASE p_size % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 3 THEN 'Array<number>' ELSE {PASCAL.format('p_name')} END AS typescript FROM part""")
def type_names(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.expr(KIND).alias("kind"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    return p.select("p_partkey", *[codegen.type_name(F.col("kind"), F.col("size"), F.col("name"), lang).alias(lang) for lang in ("java", "typescript")])
