"""Operator 9: line dedup by content-defined chunks, DataFrame functions only.

A text's lines are hashed; a rolling hash over the last ``ROLL`` line hashes ends a chunk
where it is 0 modulo ``EVERY``, so a boundary depends on nearby lines alone and a shift of
lines leaves later chunks as they are. Chunks of two or more lines with words that occur
more than once in the corpus are removed, all but the first (smallest doc_id, then place).

Equality is of bytes: chunks are grouped by their text (hash keys with whole comparison,
summed before the shuffle, so one chunk in a third of all documents is one row a task).
Where a pair of hashes stands for exactly one repeated text, the hashes then stand for that
text in the join; a pair shared by different texts is never used.

Defined cases: a null text stays null; an empty text stays empty; rows with one doc_id are
versions of one document, so repeated rows keep and lose the same chunks; of rows without a
doc_id those with equal texts are one document, and they come first, in order of a hash of the
text; doc_id may be of any type that has an order; other columns pass through.

A chunk rarely starts and ends with a passage, so ``dedup_passages``, which op9_line_dedup and
the pipeline use, compares two lines at every line instead of chunks: each line with words and
the next such line, with the blank lines between, is a run, and of every run but its first
occurrence all lines go. A repeated passage of two or more lines with words so goes whole, to
its last line, wherever it stands. Runs are told apart by SHA-256. The first occurrence of a
line in the corpus always stays; a text that has no word left is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, stored, unpacked

ROLL = 2
EVERY = 3
MIN_LINES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; a column named in a lambda would be computed
    again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bounds(hashes: Column) -> Column:
    """The index after each chunk's last line."""

    def ends(hs: Column) -> Column:
        n = F.size(hs)
        rolled = lambda i: F.xxhash64(*[F.get(hs, i - 1 - k) for k in range(ROLL)])
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(rolled(i), F.lit(EVERY)) == 0))

    return _let(hashes, ends)


def chunks(text: Column) -> Column:
    """array<struct<at, words, body>>: the chunks of a text, whose bodies joined by a newline
    are the text; words counts the lines that hold a word."""

    def cut(ls: Column, es: Column) -> Column:
        def lines(end: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(es, i - 1)).otherwise(F.lit(0))
            return F.struct(i.alias("at"), F.slice(ls, start + 1, end - start).alias("ls"))

        def told(c: Column) -> Column:
            words = F.size(F.filter(c["ls"], lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
            return F.struct(c["at"].alias("at"), words.alias("words"), F.array_join(c["ls"], "\n").alias("body"))

        return F.transform(F.transform(es, lines), told)

    return _let(_lines(text), lambda ls: _let(_bounds(F.transform(ls, lambda x: F.xxhash64(x))), lambda es: cut(ls, es)))


def _document() -> Column:
    """What tells documents apart and orders them."""
    return F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("hash"))


def _keyed(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("_h1"), F.xxhash64(F.lit("b"), c, F.length(c)).alias("_h2")]


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id and place of every chunk to remove: (_doc, _at, _h1, _h2)."""
    rows = docs.filter(F.col("text").isNotNull()).select(_document().alias("_doc"), F.explode_outer(chunks(F.col("text"))).alias("c"))
    rows = rows.filter(F.col("c.words") >= MIN_LINES).select("_doc", F.col("c.at").alias("_at"), F.col("c.body").alias("_body"))
    place = F.struct("_doc", "_at")
    by_text = rows.select("_body", place.alias("_place")).groupBy("_body").agg(F.min("_place").alias("_keep"), F.max("_place").alias("_last"))
    by_hash = by_text.select(*_keyed(F.col("_body")), "_keep", "_last").groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min("_keep").alias("_keep"), F.max("_last").alias("_last"))
    repeated = stored(by_hash.filter((F.col("_n") == 1) & (F.col("_last") > F.col("_keep"))).select("_h1", "_h2", "_keep"))
    # neither join's smaller side has a proven bound: they are never broadcast
    found = rows.select("_doc", "_at", place.alias("_place"), *_keyed(F.col("_body"))).join(repeated.hint("merge"), ["_h1", "_h2"]).filter(F.col("_place") > F.col("_keep"))
    return found.select("_doc", "_at", "_h1")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``; adds ``n_chunks_removed``."""
    gone = stored(repeated_chunks(docs).groupBy("_doc").agg(F.collect_set(F.struct("_at", "_h1")).alias("_gone")))
    names = [c for c in docs.columns if c != "n_chunks_removed"]
    rows = packed(docs.drop("n_chunks_removed"), "doc_id", "text", _doc=_document()).join(gone.hint("merge"), "_doc", "left")
    kept = F.filter(chunks(F.col("text")), lambda c: ~F.array_contains(F.col("_gone"), F.struct(c["at"].alias("_at"), F.xxhash64(c["body"]).alias("_h1"))))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"))
    removed = F.when(F.col("text").isNull() | F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    return unpacked(rows.select(*[c for c in rows.columns if c not in ("text", "_doc", "_gone")], text.alias("text"), removed.alias("n_chunks_removed")), names, "n_chunks_removed")


def _runs(ls: Column) -> Column:
    """array<struct<at, to>>: the lines that each run starts and ends with; the last has no end."""
    wordy = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    return _let(wordy, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("at"), F.get(at, k + 1).alias("to"))))


def _sha(ls: Column, run: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.slice(ls, run["at"] + 1, run["to"] - run["at"] + 1), "\n").cast("binary"), 256))


def _mark(at: Column, sha: Column) -> Column:
    return F.xxhash64(at, sha)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(_doc, _mark): the place and text, as one hash, of every run to remove."""
    made = _let(_lines(F.col("text")), lambda ls: F.transform(F.filter(_runs(ls), lambda r: r["to"].isNotNull()), lambda r: F.struct(r["at"].alias("at"), _sha(ls, r).alias("sha"))))
    rows = docs.filter(F.col("text").isNotNull()).select(_document().alias("_doc"), F.explode(made).alias("r")).select("_doc", F.col("r.at").alias("_at"), F.col("r.sha").alias("_sha"))
    place = F.struct("_doc", "_at")
    firsts = rows.groupBy("_sha").agg(F.min(place).alias("_keep"), F.max(place).alias("_last"))
    repeated = stored(firsts.filter("_last > _keep").select("_sha", "_keep"))
    # neither join's smaller side has a proven bound: they are never broadcast
    return rows.join(repeated.hint("merge"), "_sha").filter(place > F.col("_keep")).select("_doc", _mark(F.col("_at"), F.col("_sha")).alias("_mark"))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated run of lines taken out of ``text``; adds
    ``n_chunks_removed``, the number of stretches taken out."""
    gone = stored(repeated_runs(docs).groupBy("_doc").agg(F.collect_set("_mark").alias("_gone")))
    names = [c for c in docs.columns if c != "n_chunks_removed"]
    rows = packed(docs.drop("n_chunks_removed"), "doc_id", "text", _doc=_document()).join(gone.hint("merge"), "_doc", "left")

    def cut(ls: Column, runs: Column) -> Column:
        out = F.transform(runs, lambda r: F.coalesce(r["to"].isNotNull() & F.array_contains(F.col("_gone"), _mark(r["at"], _sha(ls, r))), F.lit(False)))

        def left(flags: Column) -> Column:
            flag = lambda k: F.coalesce(F.get(flags, k), F.lit(False))

            def part(r: Column, k: Column) -> Column:
                """What stays of a line with words and the blank lines after it."""
                line = F.when(flag(k) | flag(k - 1), F.array().cast("array<string>")).otherwise(F.array(F.get(ls, r["at"])))
                blank = F.when(flag(k), F.array().cast("array<string>")).otherwise(F.slice(ls, r["at"] + 2, F.coalesce(r["to"], F.size(ls)) - r["at"] - 1))
                return F.concat(line, blank)

            kept = F.concat(F.slice(ls, F.lit(1), F.get(runs, F.lit(0))["at"]), F.flatten(F.transform(runs, part)))
            stretches = F.size(F.filter(flags, lambda f, k: f & ~flag(k - 1)))
            return F.struct(F.array_join(kept, "\n").alias("text"), stretches.alias("n"))

        return _let(out, left)

    made = F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), _let(_lines(F.col("text")), lambda ls: _let(_runs(ls), lambda runs: cut(ls, runs))))
    rows = rows.withColumn("_cut", made)
    n = F.coalesce(F.col("_cut.n"), F.lit(0)).cast("long")
    text = F.when(n == 0, F.col("text")).when(F.col("_cut.text").rlike(r"[^\x20\x09-\x0D]"), F.col("_cut.text")).otherwise(F.lit(""))
    return unpacked(rows.select(*[c for c in rows.columns if c not in ("text", "_doc", "_gone", "_cut")], text.alias("text"), n.alias("n_chunks_removed")), names, "n_chunks_removed")
