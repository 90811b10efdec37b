"""Operator 2: document quality rules as a short-circuit cascade, DataFrame functions only.

Every rule is a predicate over a text's features that rejects a document. A feature is an
expression over the raw text (``FEATURES``), so a rule costs what its features cost. ``plan``
times each rule on the raw texts of a sample (of at most ``SAMPLE_ROWS`` rows, none longer than
``SAMPLE_CHARS``), less the time of a job that evaluates nothing, counts what it rejects there,
and orders the rules by rejection per cost. ``cascade`` evaluates them in that order inside one
CASE, so for a row that a rule rejects no feature of a later rule is computed. The order never
changes whether a row is kept: it is when no rule rejects it.

A feature that the frame already has as a column (``measured`` adds those of the base counts)
is read from there; ``screen`` computes none beforehand.

Defined cases: a null text has no words and fails; an empty text likewise; repeated rows
are judged one by one; a column named like an output is replaced; an empty table gives an
empty result and the rules keep their declared order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE

SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.25
MAX_DUP_LINE_SHARE = 0.5
MEAN_WORD_CHARS = (2.0, 25.0)
MAX_MARK_RUN_SHARE = 0.3


Given = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the predicate from a lookup of features by name."""

    name: str
    rejects: Callable[[Given], Column]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, first ones included.

    The windows are sorted with their places; equal neighbours are repeats. With the places
    p1 < p2 < ... of repeated windows, each covers min(3, gap to the next) new words."""
    windows = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("g"), i.alias("p")),
    )
    return F.aggregate(
        F.array(windows),
        F.lit(0),
        lambda _, ws: F.when(F.size(F.array_distinct(ws["g"])) == F.size(ws), F.lit(0)).otherwise(_covered(ws)),
    )


def _covered(windows: Column) -> Column:
    def places(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) & (i > 0) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
        return F.array_sort(F.transform(hit, lambda x: x["p"]))

    def total(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])

    return F.aggregate(F.array(F.array_sort(windows)), F.lit(0), lambda _, s: total(places(s)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


#: Each feature from the whole text (which is not null).
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: (F.length(t) - F.length(F.regexp_replace(t, r"[^\x20\x09-\x0D]+", ""))).cast("long"),
    "n_symbols": lambda t: F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
    "n_dup_lines": lambda t: F.aggregate(F.array(_lines(t)), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_repeat_words": lambda t: F.aggregate(F.array(words(t)), F.lit(0), lambda _, w: repeated_words(w)).cast("long"),
    "n_mark_runs": lambda t: F.regexp_count(t, F.lit(r"[!?]{2,}")).cast("long"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, names: Sequence[str] = BASE) -> DataFrame:
    """``docs`` with the named features as columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({n: FEATURES[n](text) for n in names})


def _given(df: DataFrame) -> Given:
    text = F.coalesce(F.col("text"), F.lit(""))
    return lambda n: F.col(n) if n in df.columns else FEATURES[n](text)


def default_rules() -> list[Rule]:
    n = lambda f: F.greatest(f("n_words"), F.lit(1))
    return [
        Rule("few_words", lambda f: f("n_words") < MIN_WORDS),
        Rule("repetition", lambda f: 100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words")),
        Rule("symbols", lambda f: f("n_symbols") > MAX_SYMBOLS_PER_WORD * n(f)),
        Rule("dup_lines", lambda f: f("n_dup_lines") > MAX_DUP_LINE_SHARE * F.greatest(f("n_lines"), F.lit(1))),
        Rule("word_length", lambda f: ~f("word_chars").between(MEAN_WORD_CHARS[0] * n(f), MEAN_WORD_CHARS[1] * n(f))),
        Rule("mark_runs", lambda f: f("n_mark_runs") > MAX_MARK_RUN_SHARE * n(f)),
    ]


def plan(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost, both measured on raw texts. The sample (the
    first ``rows`` texts that are short enough) sets the order and nothing else."""
    texts = docs.select("text").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).limit(rows).collect()
    if not texts:
        return list(rules)
    sample = docs.sparkSession.createDataFrame(texts, "text string").coalesce(1).cache()
    try:
        sample.count()

        def timed(rejects: Column) -> tuple[float, int]:
            took, job = [], sample.agg(F.count_if(rejects).alias("n"))
            for _ in range(3):
                began = time.perf_counter()
                hit = job.first()["n"]
                took.append(time.perf_counter() - began)
            return median(took), hit

        none, _ = timed(F.col("text") == "\n")
        found = []
        for r in rules:
            cost, hit = timed(r.rejects(_given(sample)))
            found.append((hit / max(cost - none, 1e-4), r))
        return [r for _, r in sorted(found, key=lambda x: -x[0])]
    finally:
        sample.unpersist()


def cascade(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rejected_by``, the first rule in order that rejects the row, or null."""
    given, verdict = _given(df), None
    for r in rules:
        hit = F.coalesce(r.rejects(given), F.lit(False))
        verdict = F.when(hit, F.lit(r.name)) if verdict is None else verdict.when(hit, F.lit(r.name))
    return df.withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))


def screen(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs`` with ``rejected_by`` and ``kept``: the cascade alone, for which no
    feature is computed that a row's verdict doesn't need."""
    given = docs.drop(*FEATURES, "rejected_by", "kept")
    rules = list(default_rules() if rules is None else rules)
    return cascade(given, plan(given, rules, sample_rows)).withColumn("kept", F.col("rejected_by").isNull())


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs``, the base counts, ``base_failed``, ``rejected_by``, ``kept``. The
    base counts are wanted of every row, so the cascade reads these and computes the rest."""
    given = docs.drop(*FEATURES, "base_failed", "rejected_by", "kept")
    rules = list(default_rules() if rules is None else rules)
    ordered = plan(given, rules, sample_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = cascade(measured(given), ordered).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & F.col("rejected_by").isNull())
