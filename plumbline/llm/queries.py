"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontam, extract, fim, langid, linedup, lm, quality, repeats, secrets, simhash, whitening
from .common import crc_mod, table

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
except ModuleNotFoundError:
    TOKENIZER = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, TOKENIZER))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = json.dumps({"conv_id": -1, "messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    rows = chat.table_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    records = rows.unionByName(spark.range(1).select(F.parse_json(F.lit(more)).alias("record")))
    turns = chat.variant_turns(records, "record", F.lit(None)).filter("layout is not null").drop("layout")
    return chat.digests(chat.format_parts(turns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup_passages(docs).select("doc_id", "n_chunks_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.judged(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")), "n_near")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = crc_mod(F.col("doc_id"), 10) == 0
    return lm.score(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return made.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_simhash, op4_secrets, op5_langid, op6_chat, op7_repeats, op8_decontam, op9_line_dedup, op10_lm, op11_fim, op12_html, op13_whitening)}
ORACLES: dict[str, str] = {
    "op11_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, a, b, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op2_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY r),
b AS (SELECT doc_id, text, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
 len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '[!?]{2,}')) AS runs FROM t LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * greatest(n_lines, 1) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR runs > 0.3 * n_words) AS kept FROM f""",
    "op6_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '(</?s>|\[/?INST\])', '\\\1', 'g')) + length(regexp_replace(text, '(</?s>|\[/?INST\])', '\\\1', 'g')) + 24 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op7_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
c AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS kept
 FROM (SELECT s.*, h, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0))) AS piece FROM s JOIN d USING (doc_id)) s GROUP BY s.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS gone FROM (SELECT w.doc_id, i, j, array_to_string(ls[i:j], chr(10)) AS body FROM w JOIN d USING (doc_id) WHERE j IS NOT NULL)),
o AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE gone),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, gone, lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f) WHERE gone AND NOT coalesce(before, false) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN o USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(n, 0) AS n_chunks_removed, CASE WHEN n IS NULL THEN text WHEN regexp_matches(kept, '[^\x20\x09-\x0D]') THEN kept ELSE '' END AS t FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_chunks_removed, length(t) AS n_chars_left, sha256(t) AS text_sha256 FROM t""",
    "op4_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
 ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'),
 ('user', 3, '(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@+-]{3,}'),
 ('key', 4, '[A-Za-z0-9+/_=-]+'), ('endpoint', 5, 'https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?[A-Za-z0-9/_.?=&%-]*')) AS v(kind, o, re)),
h AS (SELECT r, kind, o, regexp_extract_all(t, re) AS hits, regexp_split_to_array(t, re) AS parts, CASE WHEN kind = 'assign' THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re) END AS body FROM d, p WHERE regexp_matches(t, re)),
u AS (SELECT r, kind, o, i, hits[i] AS hit, body[i] AS body, length(parts[i]) + length(hits[i]) AS step FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
e AS (SELECT *, sum(step) OVER (PARTITION BY r, o ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM u),
c AS (SELECT r, kind, o, b - length(hit) AS a, b FROM e WHERE CASE kind WHEN 'assign' THEN length(body) >= 6 WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24
 WHEN 'key' THEN length(hit) >= 32 AND NOT contains(hit, '=') AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') ELSE true END),
k AS (SELECT * FROM c WHERE NOT (kind = 'key' AND EXISTS (SELECT 1 FROM c x WHERE x.r = c.r AND x.kind <> 'key' AND x.a <= c.a AND x.b >= c.b))),
s AS (SELECT k.*, EXISTS (SELECT 1 FROM k x WHERE x.r = k.r AND x.kind IN ('access', 'user') AND (k.a - x.b BETWEEN 0 AND 400 OR x.a - k.b BETWEEN 0 AND 400)) AS id,
 EXISTS (SELECT 1 FROM k x WHERE x.r = k.r AND x.kind IN ('assign', 'hex', 'key') AND (k.a - x.b BETWEEN 0 AND 400 OR x.a - k.b BETWEEN 0 AND 400)) AS secret FROM k),
g AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex, string_agg(CASE WHEN o < 3 THEN kind || ':' || a || ':' || b END, ',' ORDER BY a, o) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans
 FROM s WHERE o < 3 OR (kind = 'user' AND secret) OR (kind = 'key' AND id) OR (kind = 'endpoint' AND id AND secret) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op8_decontam": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER (ORDER BY CAST(item_id AS VARCHAR), text) AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, w[p:p + least(10, len(w)) - 1] AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT r, p, s AS n, w[p:p + s - 1] AS win FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT len(win) AS s FROM x) WHERE len(w) >= s)),
m AS (SELECT DISTINCT r, p, n, win FROM g WHERE win IN (SELECT win FROM x)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
e AS (SELECT DISTINCT r, item FROM m JOIN x USING (win)),
t AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT term, count(*) AS f FROM t GROUP BY term),
v AS (SELECT term, min(n * 1000000 + p) AS id FROM (SELECT n, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM i) GROUP BY term),
y AS (SELECT win, list_distinct(win) AS own FROM (SELECT DISTINCT win FROM x)),
z AS (SELECT win, term, len(own) AS size, row_number() OVER (PARTITION BY win ORDER BY coalesce(f, 0), id) AS rank FROM (SELECT win, own, unnest(own) AS term FROM y) JOIN v USING (term) LEFT JOIN f USING (term)),
b AS (SELECT t.r, t.p, z.win, z.size FROM z JOIN t USING (term) WHERE rank <= size * 2 // 10 + 1),
o AS (SELECT b.r, b.win FROM b JOIN t ON t.r = b.r AND t.p BETWEEN b.p - 9 AND b.p + 9 JOIN z ON z.win = b.win AND z.term = t.term GROUP BY b.r, b.p, b.win, b.size HAVING count(DISTINCT t.term) * 10 >= b.size * 8),
a AS (SELECT DISTINCT r, item FROM (SELECT r, win FROM o UNION SELECT r, win FROM m) JOIN x USING (win)),
j AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM e GROUP BY r),
l AS (SELECT r, count(*) AS n_any FROM a GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_any, 0) - coalesce(n_items, 0) AS n_near
 FROM d LEFT JOIN hit USING (r) LEFT JOIN j USING (r) LEFT JOIN l USING (r)""",
}
