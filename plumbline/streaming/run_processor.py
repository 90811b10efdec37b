"""Runs folded by a stateful processor: a state of each run, changed event by event, freed by a timer.

Every read and write of state is a message between Python and the JVM, so runs are held by the bucket
of their hash: one message reads a bucket's open runs, one writes them, and its timer is that of the run that
is due first. What a bucket holds is its open runs alone; ``BUCKETS`` is for some ten million of them.

Events are (run, kind, stage, at, seq, value): ``kind`` is migration.started, .completed, .failed,
stage.started, .completed, .failed, or anything else, which only counts; ``at`` is a timestamp,
``seq`` breaks its ties, ``value`` is a number that a run's end carries. What is kept of a run is
the smallest start and the largest end by (at, seq), of the run and of each stage, so events may come
in any order and the result is that of the batch folds (``telemetry.run_records`` and
``telemetry.stage_states``). Events without a run or a time have no place in the order and are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run string, closed boolean, n_events long, status string, started long, ended long, value long, stages array<struct<stage:string,status:string,n_starts:long,millis:long>>"
_STAGE = "stage:string,n_starts:long,start_at:long,start_seq:long,end_at:long,end_seq:long,end_kind:string"
_RUN = f"run:string,n_events:long,start_at:long,start_seq:long,end_at:long,end_seq:long,end_kind:string,value:long,latest:long,timer:long,stages:array<struct<{_STAGE}>>"
_RUN_NAMES = [f.split(":")[0] for f in _RUN.split(",stages:")[0].split(",")]
_STAGE_NAMES = [f.split(":")[0] for f in _STAGE.split(",")]
#: A number that a checkpoint keeps for good.
BUCKETS = 4096


def _earlier(state: dict, at: int, seq: int) -> None:
    if state["start_at"] is None or (at, seq) < (state["start_at"], state["start_seq"]):
        state["start_at"], state["start_seq"] = at, seq


def _later(state: dict, at: int, seq: int, kind: str) -> bool:
    last = state["end_at"] is None or (at, seq) > (state["end_at"], state["end_seq"])
    if last:
        state["end_at"], state["end_seq"], state["end_kind"] = at, seq, kind
    return last


def _status(state: dict) -> str:
    return "running" if state["end_kind"] is None else state["end_kind"].rsplit(".", 1)[1]


class RunFold(StatefulProcessor):
    """A run's record after each batch that holds events of it, and once more, ``closed``, when
    the watermark is ``idle`` microseconds past its latest event; then its state is freed."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"timer long, runs array<struct<{_RUN}>>")

    def _read(self) -> tuple[int | None, dict[str, dict]]:
        """A bucket's timer and its runs by name, each with its stages by name."""
        timer, held = self.open.get() or (None, [])
        return timer, {x[0]: dict(zip(_RUN_NAMES, x)) | {"stages": {y[0]: dict(zip(_STAGE_NAMES, y)) for y in x[-1]}} for x in held}

    def _write(self, before: int | None, runs: dict[str, dict]) -> None:
        if not runs:
            self.open.clear()
            return
        timer = min(x["timer"] for x in runs.values())
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.open.update((timer, [(*(x[n] for n in _RUN_NAMES), [tuple(y.values()) for y in x["stages"].values()]) for x in runs.values()]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, runs = self._read()
        changed = {}
        for r in rows:
            run = changed.get(r["run"])
            if run is None:
                run = runs.setdefault(r["run"], dict.fromkeys(_RUN_NAMES) | {"run": r["run"], "n_events": 0, "stages": {}})
                changed[r["run"]] = run
            run["n_events"] += 1
            run["latest"] = r["us"] if run["latest"] is None else max(run["latest"], r["us"])
            of, _, what = (r["kind"] or "").partition(".")
            if of == "migration" and what == "started":
                _earlier(run, r["us"], r["seq"])
            elif of == "migration" and what in ("completed", "failed"):
                if _later(run, r["us"], r["seq"], r["kind"]):
                    run["value"] = r["value"]
            elif of == "stage" and what in ("started", "completed", "failed") and r["stage"] is not None:
                stage = run["stages"].setdefault(r["stage"], dict.fromkeys(_STAGE_NAMES) | {"stage": r["stage"], "n_starts": 0})
                if what == "started":
                    stage["n_starts"] += 1
                    _earlier(stage, r["us"], r["seq"])
                else:
                    _later(stage, r["us"], r["seq"], r["kind"])
        # behind the latest event and never behind the watermark, where it would not fire
        mark = timerValues.getCurrentWatermarkInMs()
        for run in changed.values():
            run["timer"] = max((run["latest"] + self.idle) // 1000, mark) + 1
            yield self._record(run, False)
        self._write(timer, runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, runs = self._read()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        mark = max(timer, timerValues.getCurrentWatermarkInMs())
        for run in [x for x in runs.values() if x["timer"] <= mark]:
            yield self._record(run, True)
            del runs[run["run"]]
        self._write(None, runs)

    def _record(self, run: dict, closed: bool) -> Row:
        given = []
        for name, s in sorted(run["stages"].items()):
            if s["start_at"] is not None:
                millis = None if s["end_at"] is None else (s["end_at"] - s["start_at"]) // 1000
                given.append(Row(stage=name, status=_status(s), n_starts=s["n_starts"], millis=millis))
        return Row(run=run["run"], closed=closed, n_events=run["n_events"], status=None if run["start_at"] is None else _status(run), started=run["start_at"], ended=run["end_at"], value=run["value"], stages=given)


def records(events: DataFrame, late: str, idle: int) -> DataFrame:
    """The stream of run records (``OUTPUT``, in update mode; times in microseconds, the status null while
    no start has come). ``late``: how far behind the newest event another one may come; older ones are
    dropped, so no freed run comes back with a part of its events if ``idle`` is at least the longest
    silence inside a run."""
    e = events.filter("run is not null and at is not null").withWatermark("at", late)
    e = e.select(F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).alias("bucket"), "run", "kind", "stage", "at", F.unix_micros("at").alias("us"), F.coalesce("seq", F.lit(-1)).alias("seq"), "value")
    return e.groupBy("bucket").transformWithState(RunFold(idle), OUTPUT, "Update", "EventTime")


def last(given: DataFrame) -> DataFrame:
    """The newest record of each run among those given out."""
    of = [c for c in given.columns if c != "run"]
    return given.groupBy("run").agg(F.max_by(F.struct(*of), F.struct("n_events", "closed")).alias("r")).select("run", "r.*")
