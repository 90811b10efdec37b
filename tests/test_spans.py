"""Self times against ticks, and sampling by trace."""

import random

from plumbline.operators import spans
from pyspark.sql import functions as F

SCHEMA = "trace string, span string, parent string, started long, ended long"


def test_self_times(spark):
    r = random.Random(2)
    rows = []
    for t in "abc":
        rows.append((t, "s0", None, 0, 100))
        for i in range(1, 14):
            a = r.randint(-5, 95)
            rows.append((t, f"s{i}", f"s{r.randint(0, i - 1)}", a, a + r.randint(0, 40)))
    rows += [("d", "alone", None, 3, None), ("d", "lost", "gone", 5, 9), ("d", "self", "self", 1, 4), ("d", "back", None, 9, 2)]
    got = {(x.trace, x.span): (x.total, x.own) for x in spans.self_times(spark.createDataFrame(rows, SCHEMA)).collect()}
    ticks = {(t, s): set(range(a, max(b if b is not None else a, a))) for t, s, _, a, b in rows}
    for t, s, _, _, _ in rows:
        covered = set().union(*[ticks[u, c] for u, c, p, _, _ in rows if u == t and p == s and c != s], set())
        assert got[t, s] == (len(ticks[t, s]), len(ticks[t, s] - covered))


def test_nested_times_sum_to_the_root(spark):
    rows = [("t", "r", None, 0, 50), ("t", "a", "r", 5, 20), ("t", "b", "r", 20, 45), ("t", "c", "b", 21, 30)]
    timed = spans.self_times(spark.createDataFrame(rows, SCHEMA))
    assert timed.agg(F.sum("own")).first()[0] == 50
    names = spark.createDataFrame([("t", "r", "run"), ("t", "a", "step"), ("t", "b", "step"), ("t", "c", "call")], "trace string, span string, name string")
    assert {tuple(r) for r in spans.by_name(timed, names).collect()} == {("run", 1, 50, 10), ("step", 2, 40, 31), ("call", 1, 9, 9)}
    assert spans.self_times(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sampling(spark):
    rows = spark.range(3000).select((F.col("id") % 600).cast("string").alias("trace"), F.col("id").alias("span"))
    some = spans.kept_traces(rows, 0.3)
    n = {r["count"] for r in some.groupBy("trace").count().collect()}
    assert n == {5} and 100 < some.select("trace").distinct().count() < 260
    every = spans.kept_traces(rows, 0.0, F.col("span") == 7)
    assert {r.trace for r in every.collect()} == {"7"} and every.count() == 5
