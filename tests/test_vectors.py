"""Nearest vectors by cells against all pairs."""

import numpy as np
from plumbline.operators import vectors


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_ROWS", 9)  # so that cells are dealt to several tasks
    r = np.random.default_rng(4)
    heart = r.normal(size=(6, 5)) * 4
    x = np.concatenate([heart[i % 6] + r.normal(size=5) * 0.3 for i in range(260)]).reshape(-1, 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(12)] + [(2000, (x[4] * 7).tolist())]
    odd = [(3000, None), (3001, [0.0] * 5), (3002, [1.0, 2.0]), (3003, [float("nan")] * 5), (3004, [1.0, None, 0.0, 0.0, 0.0]), (3005, []), (3006, [float("inf")] * 5)]
    asked = [(f"q{i}", v) for i, v in rows[::20]] + [("far", [-9.0, 1.0, 0.0, 0.0, 0.1]), ("none", None), ("zero", [0.0] * 5), ("short", [1.0])]
    store = spark.createDataFrame(rows + odd, "id long, v array<float>").repartition(3)
    got = vectors.search(store, spark.createDataFrame(asked, "q string, v array<float>"), "q", "id", "v", 7).collect()
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    want = {}
    for q, v in asked[:-3]:
        want[q] = sorted((-round(float(unit(v) @ unit(w)), 5), i) for i, w in rows)[:7]
    have = {}
    for g in got:
        have.setdefault(g.q, []).append((-g.score, g.id))
    assert {q: [i for _, i in sorted(h)] for q, h in have.items()} == {q: [i for _, i in w] for q, w in want.items()}
    assert max(abs(a[0] - b[0]) for q in want for a, b in zip(sorted(have[q]), want[q])) < 2e-5


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], "id long, v array<float>"), spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>")
    ask = lambda s, q: vectors.search(s, q.withColumnRenamed("id", "q"), "q", "id", "v", 3).collect()
    assert ask(none, some) == ask(some, none) == ask(none, none) == []
    assert [tuple(r) for r in ask(some, some)] == [(1, 1, 1.0)]
