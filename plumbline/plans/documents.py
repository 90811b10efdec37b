"""Queries over undeclared JSON, made from tables, and settings in layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import json_leaves
from plumbline.operators.storage import dealt

from .registry import query, read


def documents(spark, d):
    """A JSON document for each part."""
    p = dealt(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    mail = F.concat(F.lit("write to p"), "p_partkey", F.lit("@parts.example.org now"))
    inner = F.struct(F.floor(F.col("p_size") / 2).alias("half"), mail.alias("mail"))
    doc = F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("full"), F.struct(F.col("p_brand").alias("id")).alias("brand")).alias("names"), F.array(inner, inner).alias("sizes"), F.array().cast("array<string>").alias("none"))
    return p.select(F.col("p_partkey").alias("id"), F.to_json(doc).alias("text"))


_P = "p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size // 2 AS h, 'p' || p_partkey || '@parts.example.org' AS m FROM part)"


@query(f"""WITH {_P} SELECT k AS id, r.* FROM p, LATERAL (VALUES ('id', CAST(k AS VARCHAR)), ('names.full', '"' || n || '"'), ('names.brand.id', '"' || b || '"'), ('none', '[]'), ('sizes.0.half', CAST(h AS VARCHAR)), ('sizes.1.half', CAST(h AS VARCHAR)),
 ('sizes.0.mail', '"write to ' || m || ' now"'), ('sizes.1.mail', '"write to ' || m || ' now"')) AS r(path, value)""")
def json_leaf_rows(spark, d):
    docs = documents(spark, d).select("id", F.parse_json("text").alias("doc"))
    return json_leaves.leaves(docs, ["id"], "doc").select("id", "path", "value")


@query(f"""WITH {_P} SELECT k AS id, 'sizes.' || i || '.mail' AS path, 'email' AS type, m AS value FROM p, range(2) AS t(i)""")
def json_pii(spark, d):
    return json_leaves.detect_json(documents(spark, d), ["id"], "text", ("email",))


@query(f"""WITH {_P}, s AS (SELECT *, '{{"half":' || h || ',"mail":"write to [REDACTED:email] now"}}' AS x FROM p) SELECT k AS id, '{{"id":' || k || ',"names":{{"brand":{{"id":"' || b || '"}},"full":"' || n || '"}},"none":[],"sizes":[' || x || ',' || x || ']}}' AS text FROM s""")
def json_masked(spark, d):
    return json_leaves.mask_json(documents(spark, d), ["id"], "text", ("email",))


def layers(spark, d):
    """A layer of settings for each nation, those of a region over each other by key."""
    n = read(spark, d, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    model = F.when(k % 2 == 0, F.concat(F.lit('"model":'), quoted, F.lit(",")) ).otherwise("")
    judge = F.when(k % 3 == 0, quoted).when(k % 3 == 1, '" "').otherwise("null")
    limits = F.when(k % 5 == 0, F.concat(F.lit('{"max":'), k, F.lit("}"))).otherwise(F.concat(F.lit("["), k, F.lit(","), k + 1, F.lit("]")))
    text = F.concat(F.lit('{"llm":{'), model, F.lit('"heat":'), k, F.lit('},"agents":{"judge":{"model":'), judge, F.lit('}},"limits":'), limits, F.lit("}"))
    return n.select(F.col("n_regionkey").alias("region"), k.alias("layer"), F.parse_json(text).alias("doc"))


_N = """n AS (SELECT n_regionkey AS region, n_nationkey AS k, n_name AS name FROM nation), s AS (SELECT region, 'llm.model' AS path, '"' || arg_max(name, k) || '"' AS value, max(k) AS layer FROM n WHERE k % 2 = 0 GROUP BY region
 UNION ALL SELECT region, 'llm.heat', CAST(max(k) AS VARCHAR), max(k) FROM n GROUP BY region UNION ALL SELECT region, 'agents.judge.model', CASE WHEN max(k) % 3 = 0 THEN '"' || arg_max(name, k) || '"' ELSE '" "' END, max(k) FROM n WHERE k % 3 <> 2 GROUP BY region
 UNION ALL SELECT region, CASE WHEN max(k) % 5 = 0 THEN 'limits.max' ELSE 'limits' END, CASE WHEN max(k) % 5 = 0 THEN CAST(max(k) AS VARCHAR) ELSE '[' || max(k) || ',' || (max(k) + 1) || ']' END, max(k) FROM n GROUP BY region)"""


@query(f"WITH {_N} SELECT region, path, value, layer FROM s")
def settings_merged(spark, d):
    return json_leaves.merged(layers(spark, d), ["region"], "layer", "doc")


@query(f"""WITH {_N}, o AS (SELECT region, value FROM s WHERE path = 'agents.judge.model'), b AS (SELECT region, substr(path, 5) AS path, value FROM s WHERE path LIKE 'llm.%')
 SELECT region, 'judge' AS owner, path, CASE WHEN path = 'model' AND trim(o.value, '" ') <> '' THEN o.value ELSE b.value END AS value FROM b JOIN o USING (region)
 UNION ALL SELECT region, 'judge', 'model', value FROM o WHERE trim(value, '" ') <> '' AND region NOT IN (SELECT region FROM b WHERE path = 'model')""")
def settings_of_agents(spark, d):
    """What each agent's settings are: its own, or those that it inherits."""
    return json_leaves.inherited_settings(json_leaves.merged(layers(spark, d), ["region"], "layer", "doc"), ["region"], "llm", "agents")
