"""Cycles of any length, against plain walks."""

import hashlib
import random

from plumbline.operators import cycles, graph
from pyspark.sql import functions as F


def test_no_depth_bound(spark):
    long = [(i, (i + 1) % 9) for i in range(9)] + [(3, 20), (20, 21), (30, 30)]
    got = graph.on_cycle(spark.createDataFrame(long, "src long, dst long")).collect()
    assert {r["id"]: r["length"] for r in got} == {**dict.fromkeys(range(9), 9), 30: 1}


def reached(edges, a):
    seen, todo = set(), [a]
    while todo:
        v = todo.pop()
        for x, y in edges:
            if x == v and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def components(edges):
    reach = {v: reached(edges, v) for e in edges for v in e}
    return {v: min(w for w in reach[v] if v in reach[w]) for v in reach if v in reach[v]}


def paths(edges):
    comp, out = components(edges), set()
    for root in set(comp.values()):
        if (root, root) in edges:
            out.add((root, 0, root, root))
            continue
        inner = sorted((a, b) for a, b in edges if comp.get(a) == comp.get(b) == root and a != b)
        d, todo = {root: 0}, [root]
        for v in todo:
            for a, b in inner:
                if a == v and b not in d:
                    d[b] = d[v] + 1
                    todo.append(b)
        before = {}
        for a, b in inner:
            if d[b] == d[a] + 1:
                before.setdefault(b, a)
        n, v = min((d[a], a) for a, b in inner if b == root)
        out.add((root, n, v, root))
        while v != root:
            out.add((root, d[v] - 1, before[v], v))
            v = before[v]
    return out


def made(seed):
    r = random.Random(seed)
    edges = {(f"n{r.randint(0, 18):02d}", f"n{r.randint(0, 18):02d}") for _ in range(24)}
    ring, tail = [(f"r{i:02d}", f"r{(i + 1) % 13:02d}") for i in range(13)], [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(11)]
    return sorted(edges | set(ring) | set(tail) | {("r03", "t00"), ("t11", "n00"), ("s", "s")})


def test_components_and_paths(spark):
    edges = made(1)
    df = spark.createDataFrame([*edges, *edges[:4], (None, "n00"), ("n00", None)], "src string, dst string")
    assert {x.id: x.component for x in cycles.strong_components(df).collect()} == components(edges)
    assert {tuple(x) for x in cycles.cycle_paths(df).collect()} == paths(edges)


def test_no_edges(spark):
    assert cycles.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert cycles.cycle_paths(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n, rounds, real = 100_000, [0], cycles.kept

    def counted(df):
        rounds[0] += 1
        return real(df)

    monkeypatch.setattr(cycles, "kept", counted)
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    assert [tuple(r) for r in cycles.strong_components(ring).groupBy("component").count().collect()] == [(0, n)]
    assert rounds[0] < 40


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def prints(nodes, edges):
    comp = {**{n: n for n in nodes}, **components(edges)}
    known = {}
    total = lambda hs: "-".join([str(sum(int(h[:15], 16) for h in hs)), str(sum(int(h[15:30], 16) for h in hs)), str(len(hs))])

    def of(k):
        if k not in known:
            below = [of(j) for j in {comp[b] for a, b in edges if comp[a] == k and comp[b] != k}]
            own = total([digest(f"{n}:{h}") for n, h in nodes.items() if comp[n] == k])
            known[k] = digest(f"{own}|{total([f for f, _ in below])}"), max((v for _, v in below), default=-1) + 1
        return known[k]

    return {(n, digest(f"{n}:{h}|{of(comp[n])[0]}"), of(comp[n])[1]) for n, h in nodes.items()}


def test_fingerprints(spark):
    """A graph and, beside it, the same with one node's hash changed."""
    edges, changed = made(3), "t05"
    nodes = {v: digest(v) for e in edges for v in e} | {"alone": ""}
    both = nodes | {f"z{v}": h for v, h in {**nodes, changed: "new"}.items()}
    twice = [*edges, *[(f"z{a}", f"z{b}") for a, b in edges]]
    rows = spark.createDataFrame([*both.items(), ("alone", None)], "id string, hash string")
    got = {tuple(r) for r in cycles.transitive_fingerprints(rows, spark.createDataFrame([*twice, ("gone", "n00")], "src string, dst string")).collect()}
    assert got == prints(both, twice)
    first, second = ({r for r in prints(n, edges)} for n in (nodes, {**nodes, changed: "new"}))
    assert {r[0] for r in first - second} == {v for v in nodes if changed in reached(edges, v)} | {changed}
