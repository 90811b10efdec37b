"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Each works on all rows that the one before kept. In every stage extra
columns pass through whatever their names, an empty table gives an empty one with its schema,
and long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, decontam, langid, linedup, simhash
from plumbline.llm.common import drop_stored, packed, stored, table, unpacked
from plumbline.llm.queries import TOKENIZER

#: A document of which the network is less sure than this is in no language that it has learned.
MIN_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those without text or a letter, and those whose predicted
    language has a probability below ``MIN_SCORE``. A null ``lang`` becomes the predicted one.
    Rows with a null or repeated doc_id are judged like others; where no row has a label, nothing
    can be told, and rows with a letter stay as they are."""
    net = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    rows = packed(docs, "doc_id", "text", "lang")
    told = langid.predict(rows, net, [*rows.columns])
    kept = told.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE) if net else F.col("text").rlike(r"\p{L}"))
    filled = F.coalesce("lang", F.when(F.col("lang_pred") != langid.UND, F.col("lang_pred")))
    return unpacked(kept.withColumn("lang", filled), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of lines out of the texts; ``n_chars`` follows. A text of which
    nothing is left goes; null and empty texts stay. Rows with one doc_id are versions of one
    document and lose the same lines; rows without one are told apart by their texts."""
    out = linedup.dedup_passages(packed(docs, "doc_id", "text", "n_chars")).filter((F.col("n_chunks_removed") == 0) | (F.trim("text") != ""))
    chars = F.when(F.col("n_chunks_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return unpacked(out.withColumn("n_chars", chars), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near copies, the one of the smallest doc_id (a null
    one comes last, equal ones in any order). All texts without words are copies of each other."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a window of a benchmark item. Each row is judged on its
    own: null ids, repeated ids and repeated rows make no difference; null and empty texts
    stay; an empty benchmark drops nothing."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontam.judged(packed(docs, "doc_id", "text"), items, with_text=True)
    return unpacked(found.filter(~F.col("contaminated")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding; a null text has none."""
    out = bpe.encode_decode(docs.select("doc_id", "text", "lang", "source"), TOKENIZER)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is stored, and deleted once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
