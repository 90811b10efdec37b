"""Undeclared JSON as leaves: personal data inside it, and settings in layers.

A document is a VARIANT; its containers are opened level by level, a round for each, until none is
left, so any depth and any shape goes through the same plan and a document's parts are rows that
many tasks share. A leaf's path has names and decimal indexes (``orders.0.mail``). ``rebuilt`` puts
leaves together again, from the deepest level up; objects have their names in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .pii import detect, mask_text
from .storage import kept

_STEP = "struct<name:string,at:int>"


def _kind(v: Column, lists: bool) -> Column:
    """object, array or leaf; an empty container is a leaf, and so is a list where ``lists`` says so."""
    said = F.schema_of_variant(v)
    array = F.lit(False) if lists else said.startswith("ARRAY<") & (F.to_json(v) != "[]")
    return F.when(said.startswith("OBJECT<") & (F.to_json(v) != "{}"), "object").when(array, "array").otherwise("leaf")


def leaves(docs: DataFrame, key: list[str], doc: str, lists: bool = False) -> DataFrame:
    """(key.., steps, path, value): the leaves of a VARIANT column, value as JSON text. With ``lists``
    a list is one leaf. A null document has none; a document that is a leaf has an empty path."""
    made = None
    front = kept(docs.filter(F.col(doc).isNotNull()).select(*key, F.array().cast(f"array<{_STEP}>").alias("_steps"), F.to_json(doc).alias("_text")))
    while not front.isEmpty():
        v = F.parse_json("_text")
        told = front.withColumn("_kind", _kind(v, lists))
        done = told.filter("_kind = 'leaf'").select(*key, F.col("_steps").alias("steps"), F.col("_text").alias("value"))
        made = done if made is None else made.unionByName(done)
        names = F.map_entries(F.variant_get(v, "$", "map<string,variant>"))
        parts = F.transform(names, lambda e: F.struct(F.struct(e["key"].alias("name"), F.lit(None).cast("int").alias("at")).alias("step"), F.to_json(e["value"]).alias("text")))
        items = F.transform(F.variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(F.struct(F.lit(None).cast("string").alias("name"), i.alias("at")).alias("step"), F.to_json(x).alias("text")))
        opened = told.filter("_kind <> 'leaf'").select(*key, "_steps", F.explode(F.when(F.col("_kind") == "object", parts).otherwise(items)).alias("_p"))
        front = kept(opened.select(*key, F.concat("_steps", F.array("_p.step")).alias("_steps"), F.coalesce("_p.text", F.lit("null")).alias("_text")))
    if made is None:
        made = front.select(*key, F.col("_steps").alias("steps"), F.col("_text").alias("value"))
    path = F.array_join(F.transform("steps", lambda s: F.coalesce(s["name"], s["at"].cast("string"))), ".")
    return made.select(*key, "steps", path.alias("path"), "value")


def rebuilt(found: DataFrame, key: list[str]) -> DataFrame:
    """(key.., text): documents out of (key.., steps, value)."""
    found = kept(found.select(*key, "steps", "value"))
    depth = found.agg(F.max(F.size("steps"))).first()[0] or 0
    level = found.filter(F.size("steps") == depth)
    for d in range(depth, 0, -1):
        last = F.element_at("steps", d)
        own = level.select(*key, F.slice("steps", 1, d - 1).alias("steps"), last.alias("_s"), "value")
        named = F.concat(F.to_json(F.array("_s.name")).substr(F.lit(2), F.length(F.to_json(F.array("_s.name"))) - 2), F.lit(":"), F.col("value"))
        piece = F.struct(F.col("_s.at"), F.col("_s.name"), F.when(F.col("_s.name").isNull(), F.col("value")).otherwise(named).alias("text"))
        pieces = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), ",")
        whole = F.when(F.max("_s.name").isNull(), F.concat(F.lit("["), pieces, F.lit("]"))).otherwise(F.concat(F.lit("{"), pieces, F.lit("}")))
        up = kept(own.groupBy(*key, "steps").agg(whole.alias("value")))
        level = up.unionByName(found.filter(F.size("steps") == d - 1))
    return level.select(*key, F.col("value").alias("text"))


def _strings(found: DataFrame) -> DataFrame:
    """Leaves with ``said``: the text of a string, null for others."""
    return found.withColumn("said", F.when(F.col("value").startswith('"'), F.variant_get(F.parse_json("value"), "$", "string")))


def _documents(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key.., _doc): the texts that are JSON, as VARIANT."""
    return docs.select(*key, F.try_parse_json(text).alias("_doc")).filter("_doc is not null")


def detect_json(docs: DataFrame, key: list[str], text: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(key.., path, type, value): personal data in the strings of a JSON column, however deep. A text
    that is no JSON is looked through as it is, with an empty path."""
    found = _strings(leaves(_documents(docs, key, text), key, "_doc")).filter("said is not null").select(*key, "path", F.col("said").alias("_v"))
    plain = docs.filter(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).select(*key, F.lit("").alias("path"), F.col(text).alias("_v"))
    return detect(found.unionByName(plain), "_v", [*key, "path"], types)


def mask_json(docs: DataFrame, key: list[str], text: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(key.., text): the documents with every match in a string masked and written back; shape, numbers
    and nulls stay, names are in order. A text that is no JSON is masked as it is; a null stays null.
    ``key`` tells rows apart."""
    found = _strings(leaves(_documents(docs, key, text), key, "_doc"))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    said = found.withColumn("value", F.when(F.col("said").isNull(), F.col("value")).otherwise(quoted(mask_text(F.col("said"), types))))
    plain = docs.filter(F.col(text).isNull() | F.try_parse_json(text).isNull()).select(*key, mask_text(F.col(text), types).alias("text"))
    return rebuilt(said, key).unionByName(plain)


# ---- settings in layers ---------------------------------------------------------------


def merged(layers: DataFrame, key: list[str], layer: str, doc: str) -> DataFrame:
    """(key.., path, value, layer): the settings that hold after all layers (VARIANT documents) of
    a key, the highest last: objects merge by name, anything else, lists too, replaces what was
    below its path, and an object replaces what was no object there. A null sets nothing. Of equal
    layers both are merged, the greater value last."""
    found = kept(leaves(layers.withColumn("_l", F.col(layer)), [*key, "_l"], doc, True).filter("value <> 'null' and size(steps) > 0").select(*key, "_l", F.transform("steps", lambda s: s["name"]).alias("_p"), "value"))
    best = found.groupBy(*key, "_p").agg(F.max(F.struct("_l", "value")).alias("_b")).select(*key, "_p", F.col("_b._l").alias("_l"), F.col("_b.value").alias("value"))
    # the newest layer that sets something above a path, and the newest that sets something below it
    above = best.select(*key, F.col("_p").alias("_q"), F.col("_l").alias("_at"))
    prefixes = best.select(*key, "_p", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.slice("_p", F.lit(1), i))).alias("_q"), "_l").filter(F.size("_q") < F.size("_p"))
    over = prefixes.drop("_l").join(above, [*key, "_q"]).groupBy(*key, "_p").agg(F.max("_at").alias("_over"))
    under = prefixes.groupBy(*key, F.col("_q").alias("_p")).agg(F.max("_l").alias("_under"))
    j = best.join(over, [*key, "_p"], "left").join(under, [*key, "_p"], "left")
    stays = (F.col("_over").isNull() | (F.col("_l") >= F.col("_over"))) & (F.col("_under").isNull() | (F.col("_l") > F.col("_under")))
    return j.filter(stays).select(*key, F.array_join("_p", ".").alias("path"), "value", F.col("_l").alias("layer"))


def inherited_settings(settings: DataFrame, key: list[str], base: str, owners: str) -> DataFrame:
    """(key.., owner, path, value): for each owner named below ``owners`` (agents.judge.model) every
    setting below ``base`` (llm.model), its own where it has one that is not blank, else the base's."""
    own = settings.filter(F.col("path").startswith(f"{owners}.")).select(*key, F.split("path", r"\.")[owners.count(".") + 1].alias("owner"), F.expr(f"substring(path, length(split(path, '[.]')[{owners.count('.') + 1}]) + {len(owners) + 3})").alias("path"), "value").filter("path <> ''")
    common = settings.filter(F.col("path").startswith(f"{base}.")).select(*key, F.expr(f"substring(path, {len(base) + 2})").alias("path"), F.col("value").alias("_base"))
    every = own.select(*key, "owner").distinct().join(common, key)
    j = every.join(own.filter(F.regexp_replace("value", r'["\s]', "") != ""), [*key, "owner", "path"], "full")
    return j.select(*key, "owner", "path", F.coalesce("value", "_base").alias("value"))
