"""Run and event telemetry: KPIs, durations, retention, histograms, budgets, health."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import windows


def run_kpis(runs: DataFrame) -> DataFrame:
    """(status, calls, tokens, duration) to one row; the success rate is of finished runs and
    the average duration of completed ones, a missing end counted as 0."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return runs.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.try_divide(done, done + failed), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("status") == "completed", F.coalesce("duration", F.lit(0))).otherwise(0)), done), F.lit(0.0)), 4).alias("avg_duration"),
    )


def paired(events: DataFrame, key: str, starts: Column, ends: Column, at: str, tie: str) -> DataFrame:
    """The n-th start of a key with its n-th end."""
    nth = lambda df, name: windows.ranked(df.select(key, at, tie), key, [at, tie], windows.hour(at), "n").select(key, "n", F.col(at).alias(name))
    return nth(events.filter(starts), "started").join(nth(events.filter(ends), "ended"), [key, "n"], "left")


def stage_states(events: DataFrame, key: list[str], kind: str, at: str, tie: str) -> DataFrame:
    """Folds stage events (``kind``: stage.started, stage.completed, stage.failed) to one row a
    run and stage: status, started, ended, millis, n_starts. An end goes to the stage's first
    start, as does every later one, which replaces it; an end without a start is no stage."""
    first = F.min(F.when(F.col(kind) == "stage.started", F.struct(at, tie)))
    last = F.max_by(F.struct(F.col(kind).alias("k"), F.col(at).alias("t")), F.when(F.col(kind) != "stage.started", F.struct(at, tie)))
    g = events.filter(F.col(kind).isin("stage.started", "stage.completed", "stage.failed")).groupBy(*key).agg(first.alias("_f"), last.alias("_l"), F.count_if(F.col(kind) == "stage.started").alias("n_starts"))
    status = F.when(F.col("_l.k") == "stage.completed", "completed").when(F.col("_l.k") == "stage.failed", "failed").otherwise("running")
    millis = F.floor((F.unix_micros(F.col("_l.t").cast("timestamp")) - F.unix_micros(F.col(f"_f.{at}").cast("timestamp"))) / 1000)
    return g.filter("_f is not null").select(*key, status.alias("status"), F.col(f"_f.{at}").alias("started"), F.col("_l.t").alias("ended"), millis.alias("millis"), "n_starts")


def run_records(events: DataFrame, key: str, kind: str, at: str, tie: str, values: list[str]) -> DataFrame:
    """Folds run events (migration.started, migration.completed, migration.failed) to one row a
    started run: status, started, ended and the ``values`` of its last end."""
    ended = F.col(kind).isin("migration.completed", "migration.failed")
    g = events.groupBy(key).agg(F.min(F.when(F.col(kind) == "migration.started", F.col(at))).alias("started"), F.max_by(F.struct(kind, at, *values), F.when(ended, F.struct(at, tie))).alias("_l"))
    status = F.when(F.col(f"_l.{kind}") == "migration.completed", "completed").when(F.col(f"_l.{kind}") == "migration.failed", "failed").otherwise("running")
    return g.filter("started is not null").select(key, status.alias("status"), "started", F.col(f"_l.{at}").alias("ended"), *[F.col(f"_l.{v}").alias(v) for v in values])


def runs_in_order(runs: DataFrame, started: str, key: str) -> DataFrame:
    """Newest first, by key among equals."""
    return runs.orderBy(F.desc(started), key)


def numbered_names(records: DataFrame, session: str, order: list[str], stretch: Column, form: str = "recorded-%03d") -> DataFrame:
    """Adds ``name``: the records of a session in order, recorded-001 and on."""
    return windows.ranked(records, session, order, stretch, "_n").withColumn("name", F.format_string(form, "_n")).drop("_n")


def token_bucket(requests: DataFrame, key: str, at: str, tie: str, per_minute: int, burst: int = 0) -> DataFrame:
    """(key, at, tie, granted, tokens): a bucket of ``burst`` tokens (a sixth of ``per_minute``, 1
    at least, where it is 0) that refills by whole tokens, ``per_minute`` a minute since the
    request before, and gives one to each request that finds one. A key's requests run through
    one task in order, batch by batch; only the bucket is held."""
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, at timestamp, tie long, granted boolean, tokens long"
    rows = requests.select(key, F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"))
    size = burst if burst > 0 else max(1, per_minute // 6)

    def run(frames: Iterator) -> Iterator:
        now, have, before = object(), size, None
        for frame in frames:
            granted, left = [], []
            for k, t in zip(frame[key], frame["at"]):
                if k != now:
                    now, have, before = k, size, None
                if before is not None:
                    have = min(size, have + int((t - before).total_seconds() / 60 * per_minute))
                before = t
                granted.append(have > 0)
                have = max(0, have - 1)
                left.append(have)
            yield frame.assign(granted=granted, tokens=left)

    return rows.repartition(key).sortWithinPartitions(key, "at", "tie").mapInPandas(run, schema)


def tail(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def evicted(runs: DataFrame, capacity: int, finished: Column, key: str, order: list[str]) -> DataFrame:
    """Marks the oldest finished runs of each key beyond its capacity; ``order`` begins with a
    time."""
    total = runs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_total"))
    nth = windows.running(runs.withColumn("_fin", finished), key, order, windows.hour(order[0]), {"_nth": ("sum", F.col("_fin").cast("long"))})
    j = nth.join(total, nth[key].eqNullSafe(total["_key"]))
    return j.withColumn("evicted", F.col("_fin") & (F.col("_nth") <= F.greatest(F.col("_total") - capacity, F.lit(0)))).select(*runs.columns, "evicted")


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Counts at or below each bound (cumulative once), with +Inf last."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(*by).agg(*aggs, F.count(value).alias("le_inf"))


def last_value(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def minute_budget(df: DataFrame, at: str, tokens: Column, budget: int) -> DataFrame:
    """Tokens a tumbling minute, and what is left of the budget, 0 at least."""
    m = df.groupBy(F.date_trunc("minute", at).alias("minute")).agg(F.sum(tokens).alias("used"))
    return m.withColumn("left", F.greatest(F.lit(0), budget - F.col("used")))


def sessions(df: DataFrame, key: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """Sessions end where a key's next row comes later than the gap allows."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    j = windows.lagged(df.select(key, at, tie), key, [at, tie], windows.hour(at), at, "_before")
    new = F.coalesce((micros(at) - micros("_before") > gap_seconds * 1_000_000).cast("long"), F.lit(1).cast("long"))
    rows = windows.running(j, key, [at, tie], windows.hour(at), {"session": ("sum", new)})
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def worst(df: DataFrame, key: str, severity: Column) -> DataFrame:
    return df.groupBy(key).agg(F.max(severity).alias("severity"))


def run_states(events: DataFrame, key: str, status: Column, order: list[str]) -> DataFrame:
    """Folds events to each run's last status."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))


def best_attempt(df: DataFrame, key: str, score: str, attempt: str, stop_at: float, width: int = 100_000) -> DataFrame:
    """Attempts up to the first that reaches ``stop_at``; of these the best, earliest first."""
    ran = windows.running(df, key, [attempt], F.floor(F.col(attempt) / width).cast("long"), {"_b": ("max", F.col(score))}, before=True)
    ran = ran.filter(F.coalesce(F.col("_b") < stop_at, F.lit(True)))
    return ran.groupBy(key).agg(F.max_by(attempt, F.struct(F.col(score), -F.col(attempt))).alias("best"), F.count("*").alias("tried"))
