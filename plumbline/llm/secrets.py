"""Operator 4: secret scans with multipart credential linking, DataFrame functions only.

Strong kinds (``assign``, ``access``, ``hex``) are always reported. Weak kinds are an
account name (``user``), a long mixed token (``key``) and an address (``endpoint``); such
a candidate is reported only when the complementary parts of a credential co-occur within
its scope, ``SCOPE`` code points before its start or after its end: a user needs a secret, a
key needs an identifier, an endpoint needs both. A part that overlaps the candidate is no
complement of it, and a key inside another candidate is that one's value, no part of its own.

The interval join of parts and scopes runs over each text's candidates in order of place: the
last end of a part at or before a start, and the first start of one at or after an end, are
running values, so no pairs are built.

Positions come from splitting a text by the pattern: a match starts after all earlier
parts and matches, which a running sum over the exploded matches gives in code points.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one
(rows are told apart by a row id, not by doc_id); other columns are kept; columns named
like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import packed, unpacked

SCOPE = 400
#: The patterns of the strong kinds. A run of 24 or 20 and more characters is
#: matched as such; this finds the same spans as matching any run and dropping short ones.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "user": r"""(?i:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?[A-Za-z0-9/_.?=&%-]*",
}
KINDS = list(PATTERNS)
IDENTIFIERS, SECRETS, STRONG = ("access", "user"), ("assign", "hex", "key"), ("assign", "access", "hex")


def _candidates(text: Column, kind: str) -> Column:
    """A struct for each match: order, length of the part before it, its length, validity."""
    p = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, p, F.lit(0))
    if kind == "assign":
        ok = F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda g: F.length(g) >= 6)
    elif kind == "key":
        ok = F.transform(hits, lambda h: h.rlike("[0-9]") & h.rlike("[A-Z]") & h.rlike("[a-z]"))
    else:
        ok = F.transform(hits, lambda h: F.lit(True))
    made = F.zip_with(
        F.zip_with(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("before"), F.length(b).alias("len"))),
        ok,
        lambda x, v: F.struct(F.lit(kind).alias("kind"), x["before"].alias("before"), x["len"].alias("len"), v.alias("ok")),
    )
    made = F.transform(made, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["before"].alias("before"), x["len"].alias("len"), x["ok"].alias("ok")))
    return F.when(text.rlike(PATTERNS[kind]), made).otherwise(F.array().cast("array<struct<kind:string,i:int,before:int,len:int,ok:boolean>>"))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Adds ``spans``: array<struct<start, end, kind>> by start, then kind as listed."""
    names = [c for c in docs.columns if c not in ("spans", text)]
    docs = packed(docs.drop("spans"), "doc_id", text)
    keep = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.concat(*[_candidates(body, k) for k in KINDS]).alias("_c"))
    rows = rows.select(*keep, "_row", F.explode_outer("_c").alias("_c")).repartition("_row")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("_c.kind"))
    running = W.partitionBy("_row", "_c.kind").orderBy("_c.i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("_c.before") + F.col("_c.len")).over(running)
    rows = rows.withColumn("_end", end.cast("long")).withColumn("_start", F.col("_end") - F.col("_c.len")).withColumn("_order", order)
    # rows of matches that fail stay, without a kind, so that no text loses its last row
    rows = rows.withColumn("_kind", F.when(F.col("_c.ok"), F.col("_c.kind")))
    upto = W.partitionBy("_row").orderBy("_start").rangeBetween(W.unboundedPreceding, W.currentRow)
    covered = (F.col("_kind") == "key") & (F.max(F.when(F.col("_kind") != "key", F.col("_end"))).over(upto) >= F.col("_end"))
    rows = rows.withColumn("_covered", F.coalesce(covered, F.lit(False))).withColumn("_kind", F.when(~F.col("_covered"), F.col("_kind")))
    kind = F.col("_kind")
    ends = F.array(F.struct(F.lit(True).alias("opens"), F.col("_start").alias("pos")), F.struct(F.lit(False).alias("opens"), F.col("_end").alias("pos")))
    rows = rows.select(*keep, "_row", "_kind", "_order", "_start", "_end", F.explode(ends).alias("_e"))
    pos, opens = F.col("_e.pos"), F.col("_e.opens")
    rising = W.partitionBy("_row").orderBy(pos).rangeBetween(W.unboundedPreceding, W.currentRow)
    falling = W.partitionBy("_row").orderBy(pos.desc()).rangeBetween(W.unboundedPreceding, W.currentRow)

    def beside(kinds: tuple) -> Column:
        before = pos - F.max(F.when(~opens & kind.isin(*kinds), pos)).over(rising) <= scope
        after = F.min(F.when(opens & kind.isin(*kinds), pos)).over(falling) - pos <= scope
        return F.coalesce(F.when(opens, before).otherwise(after), F.lit(False))

    rows = rows.withColumns({"_id": beside(IDENTIFIERS), "_secret": beside(SECRETS)})
    rows = rows.groupBy("_row", "_order", "_start").agg(*[F.first(c).alias(c) for c in (*keep, "_end")], F.first("_kind").alias("_kind"), F.max("_id").alias("_id"), F.max("_secret").alias("_secret"))
    told = kind.isin(*STRONG) | (kind == "user") & F.col("_secret") | (kind == "key") & F.col("_id") | (kind == "endpoint") & F.col("_id") & F.col("_secret")
    span = F.when(told, F.struct(F.col("_start").alias("start"), F.col("_order").alias("ord"), F.col("_end").alias("end"), kind.alias("kind")))
    out = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(span)).alias("spans"))
    return unpacked(out, names, F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return scanned.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
