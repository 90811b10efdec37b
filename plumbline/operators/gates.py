"""Quality gates over metric rows: a pipeline of gates, the library's gates and their builder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Gate:
    """``severity``: critical (aborts later gates), required, or advisory. ``score`` and
    ``threshold`` are reported where they are given."""

    name: str
    passes: Column
    severity: str = "required"
    skip: Column | None = None
    score: Column | None = None
    threshold: float | None = None


def evaluate(metrics: DataFrame, key: str, gates: list[Gate], scores: bool = False) -> DataFrame:
    """(key, ord, gate, severity, status[, score, threshold]): passed, failed or skipped, in
    order. A gate after a failed critical one is skipped; a failed condition that is null fails."""

    def row(i: int, g: Gate) -> Column:
        raw = F.when(g.skip if g.skip is not None else F.lit(False), "skipped").when(g.passes, "passed").otherwise("failed")
        told = [F.lit(i).alias("ord"), F.lit(g.name).alias("gate"), F.lit(g.severity).alias("severity"), raw.alias("_raw")]
        if scores:
            score = F.lit(None) if g.score is None else F.when(raw != "skipped", g.score)
            told += [score.cast("double").alias("score"), F.lit(g.threshold).cast("double").alias("threshold")]
        return F.struct(*told)

    more = ["score", "threshold"] if scores else []
    if not gates:
        return metrics.select(key, F.lit(0).alias("ord"), F.lit("").alias("gate"), F.lit("").alias("severity"), F.lit("").alias("status"), *[F.lit(None).cast("double").alias(c) for c in more]).limit(0)
    flat = metrics.select(key, F.explode(F.array(*[row(i, g) for i, g in enumerate(gates)])).alias("g")).select(key, "g.*")
    return _aborted(flat, key, more)


def _aborted(flat: DataFrame, key: str, more: list[str]) -> DataFrame:
    """The status of each gate from ``_raw``: those behind a failed critical one are skipped."""
    broke = ((F.col("_raw") == "failed") & (F.col("severity") == "critical")).cast("int")
    before = F.max(broke).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    out = flat.withColumn("status", F.when(F.coalesce(before, F.lit(0)) == 1, "skipped").otherwise(F.col("_raw")))
    if "score" in more:
        out = out.withColumn("score", F.when(F.col("status") != "skipped", F.col("score")))
    return out.select(key, "ord", "gate", "severity", "status", *more)


def overall(results: DataFrame, key: str) -> DataFrame:
    """Counts by status, advisory failures as warnings too, and whether no other gate failed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    advisory = F.col("severity") == "advisory"
    failed = F.col("status") == "failed"
    return results.groupBy(key).agg(n("passed"), n("failed"), n("skipped"), F.count_if(failed & advisory).alias("warnings"), (F.count_if(failed & ~advisory) == 0).alias("overall"))


# ---- the library's gates --------------------------------------------------------------


def score_gate(score: Column, least: float, severity: str = "required") -> Gate:
    return Gate("score", score >= least, severity, None, score, least)


def compilation_gate(compiled: Column, severity: str = "critical") -> Gate:
    return Gate("compilation", compiled, severity, None, compiled.cast("double"))


def fixture_gate(passed: Column, total: Column, least: float, severity: str = "required") -> Gate:
    """Skipped without fixtures."""
    rate = F.try_divide(passed, total)
    return Gate("fixtures", rate >= least, severity, total == 0, rate, least)


def coverage_gate(matched: Column, total: Column, least: float, severity: str = "advisory") -> Gate:
    """Skipped without functions."""
    rate = F.try_divide(matched, total)
    return Gate("coverage", rate >= least, severity, total == 0, rate, least)


def token_gate(used: Column, budget: int, severity: str = "advisory") -> Gate:
    """Skipped without a budget; the score is the share left, 0 at least."""
    left = F.greatest(F.lit(0.0), 1 - used / F.lit(float(max(budget, 1))))
    return Gate("token_budget", used <= budget, severity, F.lit(budget <= 0), left)


def error_gate(errors: Column, most: int = 0, severity: str = "critical") -> Gate:
    return Gate("errors", errors <= most, severity, None, (errors <= most).cast("double"))


SEVERITIES = ("critical", "required", "advisory")


@dataclass(frozen=True)
class Config:
    """The defaults of the pipeline. A gate is built where its threshold is above
    0, the error gate where ``max_errors`` is 0 or more; an unknown severity is required."""

    score: float = 0.8
    score_severity: str = "required"
    compilation: bool = True
    fixtures: float = 0.95
    fixture_severity: str = "required"
    coverage: float = 0.9
    coverage_severity: str = "advisory"
    max_tokens: int = 0
    token_severity: str = "advisory"
    max_errors: int = 0
    error_severity: str = "critical"


#: A gate's name, the measure that it looks at, and whether that may be at most or must be at least
#: the threshold.
MEASURES = {"compilation": "least", "score": "least", "fixtures": "least", "coverage": "least", "token_budget": "most", "errors": "most"}
SETTINGS = "ord int, gate string, threshold double, severity string"


def settings(config: Config | None = None) -> list[tuple[int, str, float, str]]:
    """A configuration as rows of ``SETTINGS``, without the gates that are off."""
    c = config or Config()
    said = [(float(c.compilation), "critical"), (c.score, c.score_severity), (c.fixtures, c.fixture_severity), (c.coverage, c.coverage_severity), (float(c.max_tokens), c.token_severity), (float(c.max_errors), c.error_severity)]
    rows = [(gate, t, s if s in SEVERITIES else "required") for gate, (t, s) in zip(MEASURES, said) if t > (-1 if gate == "errors" else 0)]
    return [(i, *row) for i, row in enumerate(rows)]


def _measures(columns: dict[str, str] | None) -> dict[str, tuple[Column, Column]]:
    """Each gate's measure, and whether there is nothing to measure."""
    col = lambda n: F.col((columns or {}).get(n, n))
    share = lambda a, b: (F.try_divide(col(a), col(b)).cast("double"), col(b) == 0)
    whole = lambda c: (c.cast("double"), F.lit(False))
    return {
        "compilation": whole(col("compiled")), "score": whole(col("score")), "fixtures": share("fixtures_passed", "fixtures_total"),
        "coverage": share("functions_matched", "functions_total"), "token_budget": whole(col("tokens")), "errors": whole(col("errors")),
    }


def configured(metrics: DataFrame, key: str, config: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(key, ord, gate, severity, status, score, threshold): a metrics table with the columns compiled,
    score, fixtures_passed, fixtures_total, functions_matched, functions_total, tokens and errors
    (``columns`` gives other names) against a table of ``SETTINGS``, which may have the key as a column, too:
    each key is then held to settings of its own. Every measure becomes a row that meets its settings in
    a join; gates without settings are off. A null measure fails."""
    rows = [F.struct(F.lit(g).alias("gate"), m.alias("_m"), F.coalesce(empty, F.lit(False)).alias("_empty")) for g, (m, empty) in _measures(columns).items()]
    found = metrics.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")
    j = found.join(config, [key, "gate"] if key in config.columns else ["gate"])
    most = F.col("gate").isin(*[g for g, way in MEASURES.items() if way == "most"])
    passes = F.when(most, F.col("_m") <= F.col("threshold")).otherwise(F.col("_m") >= F.col("threshold"))
    score = F.when(F.col("gate") == "token_budget", F.greatest(F.lit(0.0), 1 - F.col("_m") / F.col("threshold"))).when(F.col("gate") == "errors", passes.cast("double")).otherwise(F.col("_m"))
    shown = F.when(F.col("gate").isin("score", "fixtures", "coverage"), F.col("threshold"))
    raw = F.when(F.col("_empty"), "skipped").when(passes, "passed").otherwise("failed")
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("required")
    flat = j.select(key, "ord", "gate", severity.alias("severity"), raw.alias("_raw"), F.when(raw != "skipped", score).alias("score"), shown.alias("threshold"))
    return _aborted(flat, key, ["score", "threshold"])


#: How a gate of each name is made of its metrics' columns, a threshold and a severity.
MAKERS = {
    "compilation": lambda col, t, s: compilation_gate(col("compiled"), s),
    "score": lambda col, t, s: score_gate(col("score"), t, s),
    "fixtures": lambda col, t, s: fixture_gate(col("fixtures_passed"), col("fixtures_total"), t, s),
    "coverage": lambda col, t, s: coverage_gate(col("functions_matched"), col("functions_total"), t, s),
    "token_budget": lambda col, t, s: token_gate(col("tokens"), int(t), s),
    "errors": lambda col, t, s: error_gate(col("errors"), int(t), s),
}


def from_config(config: Config | None = None, columns: dict[str, str] | None = None) -> list[Gate]:
    """The gates of a configuration's rows over the columns that ``configured`` reads."""
    col = lambda n: F.col((columns or {}).get(n, n))
    return [MAKERS[gate](col, threshold, severity) for _, gate, threshold, severity in settings(config)]


# ---- scores ---------------------------------------------------------------------------


def judge(verdicts: DataFrame, key: str, verified: Column) -> DataFrame:
    """(key, total, verified, score, status): the share of verified functions, 0 without any;
    success from 0.8, partial above 0, else failed."""
    n = verdicts.groupBy(key).agg(F.count(verified).alias("total"), F.count_if(verified).alias("verified"))
    score = F.coalesce(F.try_divide("verified", "total"), F.lit(0.0))
    return n.withColumn("score", score).withColumn("status", F.when(F.col("score") >= 0.8, "success").when(F.col("score") > 0, "partial").otherwise("failed"))


def outcomes(results: DataFrame, key: str, failed: Column, found: Column) -> DataFrame:
    """(key, failed, found, status) of an extraction: success without a failure, partial if
    anything was found all the same, else failed."""
    n = results.groupBy(key).agg(F.count_if(failed).alias("failed"), F.coalesce(F.sum(found), F.lit(0)).alias("found"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("found") > 0, "partial").otherwise("failed"))


def harness_score(compiled: Column, changed: Column, lost: Column, total: Column) -> Column:
    """0 without compilation; else 0.3, 0.4 times the share of unchanged and 0.3 times the share of
    kept rows."""
    share = lambda n: 1 - F.coalesce(F.try_divide(n, total), F.lit(0.0))
    return F.when(~compiled, F.lit(0.0)).otherwise(F.lit(0.3) + 0.4 * share(changed) + 0.3 * share(lost))


# ---- proof packs ----------------------------------------------------------------------


def proof_pack(fixtures: DataFrame, results: DataFrame, key: str, passed: str) -> DataFrame:
    """Fixtures with their results; one without a result passes."""
    return fixtures.join(results.select(key, passed), key, "left").withColumn(passed, F.coalesce(passed, F.lit(True)))


def finished(results: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """(by, fixture_count, pass_count, fail_count, pass): a pack passes where no fixture failed.
    Without ``by`` there is one row, and an empty pack passes."""
    ok = F.coalesce(passed, F.lit(False))
    n = results.groupBy(*by).agg(F.count("*").alias("fixture_count"), F.count_if(ok).alias("pass_count"))
    return n.withColumn("fail_count", F.col("fixture_count") - F.col("pass_count")).withColumn("pass", F.col("fail_count") == 0)


def pack_kpis(packs: DataFrame) -> DataFrame:
    """One row over packs (fixture_count, pass_count, fail_count): totals, the pass rate over all
    fixtures and the mean number of fixtures, each 0 where there are none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return packs.agg(
        F.count("*").alias("packs"), total("fixture_count").alias("fixtures"), total("pass_count").alias("passed"), total("fail_count").alias("failed"),
        rate(total("pass_count"), total("fixture_count")).alias("pass_rate"), rate(total("fixture_count"), F.count("*")).alias("fixtures_per_pack"),
    )


def packs_in_order(packs: DataFrame) -> DataFrame:
    """Newest first, by id among equals."""
    return packs.orderBy(F.desc("started_at"), "id")
