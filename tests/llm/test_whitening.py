"""Operator 13 against numpy and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from plumbline.llm import whitening
from pyspark.sql import functions as F

SCHEMA = "vec_id long, vector array<float>, label int"


def rows(n, d, seed=0):
    r = np.random.default_rng(seed)
    made = r.normal(size=(n, d)) * np.linspace(3, 0.2, d)
    return [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(made)]


def integers(vectors):
    return [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]


@pytest.mark.parametrize("d", [3, 8, 20])
def test_against_numpy(spark, d):
    given = rows(150, d) + [(7, rows(150, d)[7][1], 1), (None, [0.5] * d, None)]
    odd = [(900, None, 0), (901, [None] * d, 0), (902, [float("nan")] + [0.0] * (d - 1), 0), (903, [float("inf")] * d, 0), (904, [-float("inf")] * d, 0), (905, [], 0), (906, [1.0] * (d + 1), 0), (907, [1.0] * (d - 1) + [None], 0)]
    df = spark.createDataFrame(given + odd, SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    x = integers(v for _, v, _ in given)
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviations = {(g[0], sum((n * a - b) ** 2 for a, b in zip(v, s))) for g, v in zip(given, x)}
    assert {(r.vec_id, int(r.deviation)) for r in got} == deviations
    k = min(8, d)
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.label for r in got} == {0, 1, 2, None}
    c = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s)] for v in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = c @ axes / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), r)
    for j in range(k):
        mine = np.array([by[g[0], j + 1].whitened for g in given])
        assert min(np.abs(mine - white[:, j]).max(), np.abs(mine + white[:, j]).max()) < 1e-9
        assert math.isclose(by[0, j + 1].explained, values[j] / np.trace(c.T @ c / n), rel_tol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_no_or_equal_vectors(spark):
    for given in ([], [(1, None, 0)], [(1, [2.0, 3.0], 0)] * 4, [(1, [], 0)]):
        df = whitening.whiten(spark.createDataFrame(given, SCHEMA))
        assert df.collect() == [] and df.columns[:4] == ["vec_id", "vector", "label", "component"]


def test_dependent_dimensions(spark):
    """Variance in one direction alone gives one component."""
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(6)], SCHEMA)).collect()
    assert len(got) == 6 and {r.component for r in got} == {1} and abs(sum(r.whitened**2 for r in got) / 6 - 1) < 1e-9


def test_large_entries_are_exact(spark):
    given = [(i, [float(np.float32(c)) for c in (3e12 * (-1) ** i, i, 1e13)], 0) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(given, SCHEMA)).collect()
    x = integers(v for _, v, _ in given)
    s = [sum(c) for c in zip(*x)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((40 * a - b) ** 2 for a, b in zip(v, s))) for i, v in enumerate(x)}


def test_clashing_columns(spark):
    df = spark.createDataFrame(rows(30, 4), SCHEMA).withColumns({c: F.lit("own") for c in ("m", "s", "d", "_d", "_n", "whitened", "n", "component")})
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "vector", "label", "m", "s", "d", "_d", "_n", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.filter("m = 'own' and _n = 'own'").count() == 30 * 4
