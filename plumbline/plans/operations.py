"""Queries over gates, scores, proof packs, audit events, metrics and event folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import plugins
from plumbline.functions import scalars as S
from plumbline.operators import audit, diff, fixtures, gates, metrics, telemetry, windows, spans

from .catalogue import ORDERS, cents, micros, orders_after, orders_before
from .registry import query, read

# ---- gates and scores -----------------------------------------------------------------

SUPPLIERS = """m AS (SELECT l_suppkey AS k, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS passed, count(*) FILTER (l_linestatus = 'F') AS matched, CAST(sum(l_linenumber) AS BIGINT) AS tokens, count(*) FILTER (l_quantity > 49) AS errors,
 l_suppkey % 10 <> 3 AS compiled, (l_suppkey % 7) / 6 AS score FROM lineitem GROUP BY l_suppkey UNION ALL SELECT -1, 0, 0, 0, 0, 0, true, 1)"""


def supplier_metrics(spark, d):
    k = F.col("l_suppkey")
    m = read(spark, d, "lineitem").groupBy(k.alias("k")).agg(F.count("*").alias("fixtures_total"), F.count_if(F.col("l_returnflag") != "R").alias("fixtures_passed"), F.count_if(F.col("l_linestatus") == "F").alias("functions_matched"), F.sum("l_linenumber").cast("long").alias("tokens"), F.count_if(F.col("l_quantity") > 49).alias("errors"))
    m = m.withColumns({"functions_total": F.col("fixtures_total"), "compiled": F.col("k") % 10 != 3, "score": (F.col("k") % 7) / 6})
    none = spark.sql("SELECT -1L AS k, 0L AS fixtures_total, 0L AS fixtures_passed, 0L AS functions_matched, 0L AS tokens, 0L AS errors, 0L AS functions_total, true AS compiled, 1.0D AS score")
    return m.unionByName(none)


CONFIG = gates.Config(score=0.3, fixtures=0.7, coverage=0.4, max_tokens=2_000, max_errors=20, error_severity="odd")


@query(f"""WITH {SUPPLIERS}, g AS (SELECT k, unnest([{{'ord': 0, 'gate': 'compilation', 'severity': 'critical', 'raw': CASE WHEN compiled THEN 'passed' ELSE 'failed' END, 'score': CAST(CAST(compiled AS INT) AS DOUBLE), 'threshold': CAST(NULL AS DOUBLE)}},
 {{'ord': 1, 'gate': 'score', 'severity': 'required', 'raw': CASE WHEN score >= 0.3 THEN 'passed' ELSE 'failed' END, 'score': round(score, 6), 'threshold': CAST(0.3 AS DOUBLE)}},
 {{'ord': 2, 'gate': 'fixtures', 'severity': 'required', 'raw': CASE WHEN total = 0 THEN 'skipped' WHEN passed / total >= 0.7 THEN 'passed' ELSE 'failed' END, 'score': CASE WHEN total > 0 THEN round(passed / total, 6) END, 'threshold': CAST(0.7 AS DOUBLE)}},
 {{'ord': 3, 'gate': 'coverage', 'severity': 'advisory', 'raw': CASE WHEN total = 0 THEN 'skipped' WHEN matched / total >= 0.4 THEN 'passed' ELSE 'failed' END, 'score': CASE WHEN total > 0 THEN round(matched / total, 6) END, 'threshold': CAST(0.4 AS DOUBLE)}},
 {{'ord': 4, 'gate': 'token_budget', 'severity': 'advisory', 'raw': CASE WHEN tokens <= 2000 THEN 'passed' ELSE 'failed' END, 'score': round(greatest(CAST(0 AS DOUBLE), 1 - tokens / 2000), 6), 'threshold': CAST(NULL AS DOUBLE)}},
 {{'ord': 5, 'gate': 'errors', 'severity': 'required', 'raw': CASE WHEN errors <= 20 THEN 'passed' ELSE 'failed' END, 'score': CAST(CAST(errors <= 20 AS INT) AS DOUBLE), 'threshold': CAST(NULL AS DOUBLE)}}]) AS x FROM m),
 s AS (SELECT k, x.ord AS ord, x.gate AS gate, x.severity AS severity, CASE WHEN x.ord > 0 AND NOT first_value(x.raw = 'passed') OVER (PARTITION BY k ORDER BY x.ord) THEN 'skipped' ELSE x.raw END AS status, x.score AS sc, x.threshold AS threshold FROM g)
 SELECT k, ord, gate, severity, status, CASE WHEN status <> 'skipped' THEN sc END AS score, threshold FROM s""")
def library_gates(spark, d):
    r = gates.configured(supplier_metrics(spark, d), "k", spark.createDataFrame(gates.settings(CONFIG), gates.SETTINGS))
    return r.withColumn("score", F.round("score", 6))


@query("""SELECT source, count(quality) AS total, count(*) FILTER (quality = 1) AS verified, round(coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 0), 6) AS score,
 CASE WHEN coalesce(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 0) >= 0.8 THEN 'success' WHEN count(*) FILTER (quality = 1) > 0 THEN 'partial' ELSE 'failed' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def judge_scores(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return gates.judge(j, "source", F.col("quality") == 1).withColumn("score", F.round("score", 6))


@query("""SELECT p_brand, count(*) FILTER (p_size = 50) AS failed, CAST(sum(CASE WHEN p_size = 50 THEN 0 ELSE p_size % 3 END) AS BIGINT) AS found,
 CASE WHEN count(*) FILTER (p_size = 50) = 0 THEN 'success' WHEN sum(CASE WHEN p_size = 50 THEN 0 ELSE p_size % 3 END) > 0 THEN 'partial' ELSE 'failed' END AS status FROM part GROUP BY p_brand""")
def extraction_outcomes(spark, d):
    bad = F.col("p_size") == 50
    return gates.outcomes(read(spark, d, "part"), "p_brand", bad, F.when(bad, 0).otherwise(F.col("p_size") % 3)).withColumn("found", F.col("found").cast("long"))


PACKS = "p AS (SELECT source, count(*) AS f, count(*) FILTER (coalesce(quality, 0) = 1) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"


def packs(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return gates.finished(j, ["source"], F.col("quality") == 1)


@query(f"WITH {PACKS} SELECT source, f AS fixture_count, ok AS pass_count, f - ok AS fail_count, f = ok AS pass FROM p")
def finished_packs(spark, d):
    return packs(spark, d)


@query(f"WITH {PACKS} SELECT count(*) AS packs, CAST(sum(f) AS BIGINT) AS fixtures, CAST(sum(ok) AS BIGINT) AS passed, CAST(sum(f - ok) AS BIGINT) AS failed, round(sum(ok) / sum(f), 6) AS pass_rate, round(sum(f) / count(*), 6) AS fixtures_per_pack FROM p")
def pack_kpis(spark, d):
    return gates.pack_kpis(packs(spark, d)).withColumns({c: F.round(c, 6) for c in ("pass_rate", "fixtures_per_pack")})


@query("""WITH r AS (SELECT 'rule ' || item_id AS description, item_id % 3 AS k, item_id FROM benchmark)
 SELECT CASE k WHEN 0 THEN 'R1' ELSE 'm.' || item_id || '.rule1' END AS id, CASE k WHEN 0 THEN 'known' WHEN 1 THEN '[]' ELSE 'no idea' END AS description, 'm.' || item_id AS ref, CASE k WHEN 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM r WHERE k <> 1""")
def extracted_rules(spark, d):
    """Rules that a stub provider answers: JSON, an empty list, or prose."""
    k = F.col("item_id") % 3
    body = F.when(k == 0, "ASK-JSON").when(k == 1, "ASK-NONE").otherwise("ASK-PROSE")
    f = read(spark, d, "benchmark").select(F.lit("m").alias("module"), F.col("item_id").cast("string").alias("function"), body.alias("body"))
    stub = plugins.Stub([("ASK-JSON", '<think>hm</think>[{"id": "R1", "description": "known", "confidence": 0.9, "tags": ["a"]}]'), ("ASK-NONE", "[]")], "no idea")
    return plugins.extracted_rules(f, stub).drop("tags")


@query("""SELECT CAST(item_id AS VARCHAR) AS function, item_id % 4 IN (0, 2) AS equivalent FROM benchmark""")
def stub_verdicts(spark, d):
    k = F.col("item_id") % 4
    body = F.when(k == 0, "Q0").when(k == 1, "Q1").when(k == 2, "Q2").otherwise("Q3")
    f = read(spark, d, "benchmark").select(F.lit("m").alias("module"), F.col("item_id").cast("string").alias("function"), body.alias("body"), F.lit("code").alias("snippet"))
    stub = plugins.Stub([("Q0", '{"equivalent": true, "reason": "same"}'), ("Q1", 'I say {"equivalent": false} here'), ("Q2", "The logic is preserved."), ("Q3", "Something is missing and wrong, though faithful.")])
    return plugins.verdicts(f, stub).select("function", "equivalent")


# ---- audit and metrics ----------------------------------------------------------------


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'agent.error' WHEN 'purchase' THEN 'llm.response' WHEN 'click' THEN 'fixture.run' ELSE 'workflow.end' END AS event_type,
 CASE event_type WHEN 'error' THEN 'Agent u' || user_id || ' failed' WHEN 'purchase' THEN 'LLM response from p/m' || user_id WHEN 'click' THEN 'Fixture f' || event_id || ': ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE 'Workflow completed: score=0.50' END AS message,
 CASE event_type WHEN 'error' THEN false WHEN 'click' THEN event_id % 2 = 0 ELSE true END AS success, CASE WHEN event_type = 'purchase' THEN CAST(2 * user_id AS VARCHAR) END AS total_tokens, CASE WHEN event_type = 'error' THEN 'boom' WHEN event_type = 'click' AND event_id % 2 = 1 THEN 'odd' END AS error FROM events""")
def audit_events(spark, d):
    e = read(spark, d, "events")
    u, i, kind = F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type")
    made = (
        F.when(kind == "error", audit.agent_error(F.concat(F.lit("u"), u), F.lit("w"), F.lit("boom")))
        .when(kind == "purchase", audit.llm_response(F.lit("p"), F.concat(F.lit("m"), u), F.lit(5), F.col("user_id"), F.col("user_id")))
        .when(kind == "click", audit.fixture_run(F.concat(F.lit("f"), i.cast("string")), i % 2 == 0, F.lit(5), F.when(i % 2 == 0, "").otherwise("odd")))
        .otherwise(audit.workflow_end(F.lit("w"), F.lit(True), F.lit(5), F.lit(0.5), F.lit("out")))
    )
    return e.select("event_id", made.alias("a")).select("event_id", "a.event_type", "a.message", "a.success", F.try_element_at("a.details", F.lit("total_tokens")).alias("total_tokens"), "a.error")


def observations(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("event_type").alias("kind"), (cents("value") / 1000).alias("seconds"), (F.col("event_id") % 5 != 0).alias("ok"), F.col("user_id").alias("tokens"), (F.col("event_id") % 11).cast("double").alias("score"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))


@query("""SELECT event_type AS kind, count(*) AS total, count(*) FILTER (event_id % 5 = 0) AS errors, CAST(sum(user_id) AS BIGINT) AS tokens, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS millis, arg_max(event_id % 11, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS score FROM events GROUP BY 1""")
def recorded_metrics(spark, d):
    r = metrics.recorded(observations(spark, d), ["kind"])
    return r.select("kind", "total", "errors", F.col("tokens").cast("long").alias("tokens"), F.round(F.col("seconds") * 1000).cast("long").alias("millis"), F.col("score").cast("long").alias("score"))


@query("""WITH e AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS c FROM events), b AS (SELECT unnest([1000, 5000, 100000]) AS b, unnest(['10', '50', '1000']) AS t),
 h AS (SELECT event_type, count(*) AS n, CAST(sum(c) AS BIGINT) AS s FROM e GROUP BY 1)
 SELECT 'v_' || event_type AS name, 'v_' || event_type || '_bucket{kind="' || event_type || '",le="' || t || '"} ' || (SELECT count(*) FROM e WHERE e.event_type = h.event_type AND c <= b) AS line FROM h, b
 UNION ALL SELECT 'v_' || event_type, 'v_' || event_type || '_bucket{kind="' || event_type || '",le="+Inf"} ' || n FROM h UNION ALL SELECT 'v_' || event_type, 'v_' || event_type || '_count{kind="' || event_type || '"} ' || n FROM h
 UNION ALL SELECT 'v_' || event_type, 'v_' || event_type || '_sum{kind="' || event_type || '"} ' || (s // 100) || CASE WHEN s % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(s % 100 AS VARCHAR), 2, '0'), '0') END FROM h
 UNION ALL SELECT 'v_' || event_type, '# HELP v_' || event_type || ' of events' FROM h UNION ALL SELECT 'v_' || event_type, '# TYPE v_' || event_type || ' histogram' FROM h""")
def metrics_exposition(spark, d):
    e = read(spark, d, "events").select("event_type", (cents("value").cast("decimal(20,2)") / 100).alias("v"))
    h = metrics.histogram(e, "v", ["event_type"], (10.0, 50.0, 1000.0))
    m = h.select(F.concat(F.lit("v_"), "event_type").alias("name"), F.lit("histogram").alias("kind"), F.lit("of events").alias("help"), F.create_map(F.lit("kind"), "event_type").alias("labels"), F.lit(None).cast("double").alias("value"), "buckets", F.round("sum", 2).alias("sum"), "count")
    return metrics.exposition(m).select("name", "line")


@query("""SELECT event_id, (event_id // 8) || CASE WHEN event_id % 8 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(event_id % 8 * 125 AS VARCHAR), 3, '0'), '0') END AS number, CASE WHEN event_id = 0 THEN '0' ELSE '-' || event_id END AS negative FROM events""")
def number_texts(spark, d):
    return read(spark, d, "events").select("event_id", metrics.number_text(F.col("event_id") / 8).alias("number"), metrics.number_text(-F.col("event_id").cast("double")).alias("negative"))


# ---- event folds ----------------------------------------------------------------------

FOLD = """e AS (SELECT user_id, event_id % 3 AS stage, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 'stage.started' WHEN 'purchase' THEN 'stage.completed' WHEN 'error' THEN 'stage.failed' ELSE 'log' END AS kind FROM events),
 s AS (SELECT user_id, stage, count(*) AS n_starts, min(us::HUGEINT * 1000000000 + event_id) AS first, arg_min(us, us::HUGEINT * 1000000000 + event_id) AS us FROM e WHERE kind = 'stage.started' GROUP BY 1, 2),
 l AS (SELECT user_id, stage, arg_max(kind, us::HUGEINT * 1000000000 + event_id) AS kind, arg_max(us, us::HUGEINT * 1000000000 + event_id) AS us FROM e WHERE kind IN ('stage.completed', 'stage.failed') GROUP BY 1, 2)"""


@query(f"""WITH {FOLD} SELECT user_id, stage, CASE l.kind WHEN 'stage.completed' THEN 'completed' WHEN 'stage.failed' THEN 'failed' ELSE 'running' END AS status, n_starts, CAST(floor((l.us - s.us) / 1000) AS BIGINT) AS millis FROM s LEFT JOIN l USING (user_id, stage)""")
def stage_states(spark, d):
    k = F.col("event_type")
    kind = F.when(k == "click", "stage.started").when(k == "purchase", "stage.completed").when(k == "error", "stage.failed").otherwise("log")
    e = read(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("stage"), "ts", "event_id", kind.alias("kind"))
    return telemetry.stage_states(e, ["user_id", "stage"], "kind", "ts", "event_id").select("user_id", "stage", "status", "n_starts", F.col("millis").cast("long").alias("millis"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts)::HUGEINT * 1000000000 + event_id AS o, event_type, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events),
 s AS (SELECT user_id FROM e WHERE event_type = 'signup' GROUP BY 1), l AS (SELECT user_id, arg_max(event_type, o) AS k, arg_max(tokens, o) AS tokens FROM e WHERE event_type IN ('purchase', 'error') GROUP BY 1)
 SELECT user_id, CASE k WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, tokens FROM s LEFT JOIN l USING (user_id)""")
def run_records(spark, d):
    k = F.col("event_type")
    kind = F.when(k == "signup", "migration.started").when(k == "purchase", "migration.completed").when(k == "error", "migration.failed").otherwise("log")
    e = read(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"), cents("value").alias("tokens"))
    return telemetry.run_records(e, "user_id", "kind", "ts", "event_id", ["tokens"]).select("user_id", "status", "tokens")


@query("""SELECT event_id, 'recorded-' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS name FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)""")
def recorded_names(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts")
    return telemetry.numbered_names(e, "user_id", ["ts", "event_id"], windows.hour("ts")).select("event_id", "name")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT user_id, event_id, us, n, true AS granted, CAST(2 AS BIGINT) AS tokens FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.event_id, o.us, o.n, least(3, r.tokens + CAST(floor((o.us // 10 - r.us // 10) / 60000000) AS BIGINT)) > 0, greatest(0, least(3, r.tokens + CAST(floor((o.us // 10 - r.us // 10) / 60000000) AS BIGINT)) - 1) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
 SELECT event_id, granted, tokens FROM r""")
def token_bucket(spark, d):
    """A bucket of three tokens, one more every ten minutes."""
    e = read(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    e = e.select("user_id", F.timestamp_micros(F.floor(F.col("us") / 10)).alias("ts"), "event_id")  # a minute is ten here
    return telemetry.token_bucket(e, "user_id", "ts", "event_id", 1, 3).select(F.col("tie").alias("event_id"), "granted", "tokens")


# ---- comparisons ----------------------------------------------------------------------


@query(f"""WITH {ORDERS} SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'inserted' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN a ON b.k = a.k
 WHERE b.k IS NULL OR a.k IS NULL OR b.o_orderstatus <> a.o_orderstatus OR b.price <> a.price OR a.k % 5 = 0""")
def table_diff_new_column(spark, d):
    """The later version has a column more; where that is not null the row is modified."""
    b = orders_before(spark, d)
    a = orders_after(b).withColumn("note", F.when(F.col("k") % 5 == 0, "new"))
    return diff.row_diff(b, a, ["k"])


@query(f"""WITH {ORDERS}, j AS (SELECT coalesce(b.k, a.k) % 7 AS part, CASE WHEN b.k IS NULL THEN 'i' WHEN a.k IS NULL THEN 'd' WHEN b.o_orderstatus <> a.o_orderstatus OR b.price <> a.price THEN 'm' END AS c FROM b FULL JOIN a ON b.k = a.k)
 SELECT part, concat_ws(', ', CASE WHEN count(*) FILTER (c = 'i') > 0 THEN count(*) FILTER (c = 'i') || ' inserted' END, CASE WHEN count(*) FILTER (c = 'd') > 0 THEN count(*) FILTER (c = 'd') || ' deleted' END, CASE WHEN count(*) FILTER (c = 'm') > 0 THEN count(*) FILTER (c = 'm') || ' modified' END) AS summary FROM j WHERE c IS NOT NULL GROUP BY part""")
def table_change_text(spark, d):
    b = orders_before(spark, d)
    return diff.summary_text(diff.row_diff(b, orders_after(b), ["k"]).withColumn("part", F.col("k") % 7), ["part"])


@query("""SELECT 'nation' AS tbl, '{"n_nationkey":' || n_nationkey || '}' AS key, 'modified' AS change FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'region', NULL, 'missing table'""")
def tables_diff(spark, d):
    n = read(spark, d, "nation")
    after = n.withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 0, "?").otherwise(F.col("n_name")))
    return diff.tables_diff({"nation": n, "region": read(spark, d, "region")}, {"nation": after}, {"nation": ["n_nationkey"], "region": ["r_regionkey"]})


@query("""WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), a AS (SELECT k || '/' || y AS k, n, s FROM y), b AS (SELECT k || '/' || (y - 1) AS k, n, CASE WHEN n % 2 = 0 THEN s ELSE '?' END AS s FROM y)
 SELECT b.k, b.n - coalesce(a.n, 0) AS n_delta, a.k IS NULL AS is_new, coalesce(a.s, '') AS old_status, b.s AS new_status, a.s IS DISTINCT FROM b.s AS status_changed FROM b LEFT JOIN a USING (k)""")
def stage_delta_status(spark, d):
    y = read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    k = lambda c: F.concat_ws("/", "o_orderpriority", c.cast("string")).alias("k")
    new = y.select(k(F.col("y") - 1), "n", F.when(F.col("n") % 2 == 0, F.col("s")).otherwise("?").alias("s"))
    return diff.stage_delta(y.select(k(F.col("y")), "n", "s"), new, "k", ["n"], "s")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'missing' WHEN 1 THEN 'body' WHEN 3 THEN 'header' ELSE NULL END AS reason FROM events""")
def fixture_rules(spark, d):
    """Rules of a fixture replace the defaults: 1 and 2 differ in ``ts``, which the defaults ignore
    and the rules of 1 do not; 3 and 4 differ in a header, which the rules of 4 ignore."""
    i = F.col("event_id") % 8
    lists = "struct<ignore_json_fields:array<string>,ignore_header_fields:array<string>>"
    rules = F.when(i == 1, F.from_json(F.lit('{"ignore_json_fields": ["other"]}'), lists)).when(i == 4, F.from_json(F.lit('{"ignore_header_fields": [" KIND ", ""]}'), lists))
    e = read(spark, d, "events").select(
        "event_id", F.when(i != 0, F.struct(F.lit("GET").alias("method"))).alias("http"), F.lit(200).alias("expected_status"), F.lit(200).alias("status"),
        F.create_map(F.lit("Kind"), F.lit("a")).alias("expected_header"), F.create_map(F.lit("kind"), F.when(i.isin(3, 4), "b").otherwise("a")).alias("header"),
        F.when(i.isin(1, 2), '{"ts": 1, "x": {"ts": 5}}').otherwise("{}").alias("expected_body"), F.when(i.isin(1, 2), '{"x": {"ts": 5}, "ts": 2}').otherwise("{}").alias("body"), rules.alias("rules"),
    )
    return fixtures.compare(e, ["ts"], rules="rules").select("event_id", "reason")


@query("""SELECT event_id, event_type AS first, '' AS none FROM events""")
def flat_headers(spark, d):
    h = F.create_map(F.lit("Kind"), F.array(F.col("event_type"), F.lit("second")), F.lit("None"), F.array().cast("array<string>"))
    return read(spark, d, "events").select("event_id", fixtures.flat_headers(h).alias("h")).select("event_id", F.col("h.Kind").alias("first"), F.col("h.None").alias("none"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(CAST(30000 AS BIGINT), CAST(2000 * power(2, event_id % 7) AS BIGINT)) ELSE 0 END AS wait, epoch_us(ts) // 60000000 AS minute FROM events""")
def retry_waits(spark, d):
    wait = F.when(F.col("event_id") % 4 == 0, S.backoff_ms(F.col("event_id") % 7)).otherwise(F.lit(0).cast("long"))
    return read(spark, d, "events").select("event_id", wait.alias("wait"), F.floor(micros("ts") / 60_000_000).cast("long").alias("minute"))


def order_spans(spark, d):
    """A trace for each order: a root of 60 units and a child for each line, which may overlap."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace"), F.concat(F.lit("l"), "l_linenumber").alias("span"), F.lit("root").alias("parent"), ((F.col("l_linenumber") * 7) % 40).cast("long").alias("started"), F.floor(F.col("l_quantity")).cast("long").alias("_q"))
    children = lines.select("trace", "span", "parent", "started", (F.col("started") + F.col("_q") % 25).alias("ended"))
    roots = lines.select("trace", F.lit("root").alias("span"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("started"), F.lit(60).cast("long").alias("ended")).distinct()
    return roots.unionByName(children)


@query("""WITH l AS (SELECT l_orderkey AS trace, 'l' || l_linenumber AS span, CAST((l_linenumber * 7) % 40 AS BIGINT) AS s, CAST(floor(l_quantity) AS BIGINT) % 25 AS n FROM lineitem),
 t AS (SELECT trace, count(DISTINCT tick) AS covered FROM (SELECT trace, unnest(range(s, least(s + n, 60))) AS tick FROM l) GROUP BY trace)
 SELECT trace, span, n AS total, n AS own FROM l UNION ALL SELECT trace, 'root', 60, 60 - coalesce(covered, 0) FROM (SELECT DISTINCT trace FROM l) LEFT JOIN t USING (trace)""")
def span_self_times(spark, d):
    return spans.self_times(order_spans(spark, d)).select("trace", "span", "total", "own")
