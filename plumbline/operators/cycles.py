"""Cycles of directed graphs: strong components, one cycle each, transitive fingerprints.

Rounds follow the logarithm of a graph's longest chain, not its length:

* nodes that no edge enters or leaves go (``_trimmed``);
* chains of nodes with one edge in and one out become one edge each, found by pointer doubling;
  a ring of such nodes is a component (``_chains``);
* what is left takes the least number that reaches each node, and the least that it reaches, by
  edges and by jumps at once (``_least``): a node's own least, what that one's is, and that of an
  ancestor twice as far away each round. Nodes whose two numbers agree are one component; of the
  others only edges between nodes of equal pairs can be inside one.

Nodes are numbers in a random order, so that expected rounds do not depend on how ids are
given out. Each round is a table in the shared folder; those that no later one reads are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F

from .storage import dropped, kept, numbered

#: Trimming and contraction go on while they take away this share of the edges.
SHRINKS = 0.1


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def _numbers(ids: DataFrame) -> DataFrame:
    """(id, n): distinct ids with numbers in an order of their hashes."""
    made = ids.distinct().withColumn("_h", F.xxhash64("id"))
    return kept(numbered(made.withColumn("_o", F.struct("_h", "id")), "_o", "n").select("id", "n"))


def _as_numbers(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of numbers."""
    j = edges.join(_renamed(numbers, id="src", n="_s"), "src").join(_renamed(numbers, id="dst", n="_d"), "dst")
    return j.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source is entered and whose target is left."""
    return edges.join(_renamed(edges, dst="src").distinct(), "src", "left_semi").join(_renamed(edges, src="dst").distinct(), "dst", "left_semi").select(*edges.columns)


def _doubled(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int) -> DataFrame:
    """``step`` on a state and itself until its rows with ``moved`` are none, at most ``rounds`` times."""
    for _ in range(rounds):
        new = kept(step(state, state))
        dropped(state)
        state = new
        if state.filter("moved").isEmpty():
            break
    return state


def _passed(edges: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(v, prev, next): nodes with one edge in and one out that are not in ``fixed`` (v)."""
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("_i"), F.min("src").alias("prev")).filter("_i = 1")
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("_o"), F.min("dst").alias("next")).filter("_o = 1")
    both = into.join(out, "v").select("v", "prev", "next")
    return both if fixed is None else both.join(fixed.select("v"), "v", "left_anti")


def _chains(edges: DataFrame, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Contracts chains of passed nodes. Gives edges (src, dst, len, first) with the chains as one
    edge each (``first`` is a chain's first node, null for a plain edge), members (v, first, at: place
    from 1, head, tail) of the chains, and rings (v, ring: the least node) without a way in or out; without a passed node neither."""
    passed = kept(_passed(edges, fixed))
    n = passed.count()
    one = lambda: edges.select("src", "dst", F.lit(1).cast("long").alias("len"), F.lit(None).cast("long").alias("first"))
    if not n:
        return one(), None, None
    before = _renamed(passed, v="prev").withColumn("_p", F.lit(True))
    moved = F.col("_p").isNotNull()
    start = passed.join(before, "prev", "left").select("v", F.when(moved, F.col("prev")).otherwise(F.col("v")).alias("b"), moved.cast("long").alias("steps"), F.least("v", F.when(moved, F.col("prev")).otherwise(F.col("v"))).alias("low"), moved.alias("moved"))

    def step(s: DataFrame, t: DataFrame) -> DataFrame:
        far = _renamed(t, v="b", b="_b", steps="_s", low="_l")
        return s.join(far, "b").select("v", F.col("_b").alias("b"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("low", "_l").alias("low"), (F.col("_s") > 0).alias("moved"))

    state = _doubled(kept(start), step, ceil(log2(max(n, 2))) + 1)
    rings = state.filter("moved").select("v", F.col("low").alias("ring"))
    on = state.filter("not moved").select("v", F.col("b").alias("first"), (F.col("steps") + 1).alias("at"))
    on = on.join(passed, "v")
    ends = on.groupBy("first").agg(F.max("at").alias("len"), F.max_by("next", "at").alias("tail"), F.min_by("prev", "at").alias("head"))
    members = on.join(ends, "first").select("v", "first", "at", "head", "tail")
    plain = one().join(_renamed(passed, v="src"), "src", "left_anti").join(_renamed(passed, v="dst"), "dst", "left_anti").select("src", "dst", "len", "first")
    short = members.filter("v = first").join(_renamed(ends, first="first", len="len"), "first").select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.col("len") + 1).alias("len"), "first")
    return kept(plain.unionByName(short)), members, rings


def _least(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(v, c, d): the least number that reaches each node of the edges, and the least that it reaches,
    itself included. Both ways run at once, as nodes 2 v and 2 v + 1. In a round each node asks those
    with an edge to it, its least so far and its ancestor (``j``), which is twice as far away each time."""
    ends = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()
    way = lambda a, b, side: edges.select((F.col(a) * 2 + side).alias("at"), (F.col(b) * 2 + side).alias("v"))
    both = kept(way("src", "dst", 0).union(way("dst", "src", 1)))
    nodes = ends.select((F.col("v") * 2).alias("v")).union(ends.select((F.col("v") * 2 + 1).alias("v")))
    state = kept(nodes.join(both.groupBy("v").agg(F.max("at").alias("j")), "v", "left").select("v", F.col("v").alias("c"), F.coalesce("j", "v").alias("j"), F.col("v").alias("was")))
    for _ in range(max_rounds):
        asks = both.withColumn("kind", F.lit(0)).union(state.select("c", "v", F.lit(0))).union(state.select("j", "v", F.lit(1))).union(state.select("v", "v", F.lit(2)))
        heard = asks.join(_renamed(state, v="at", c="_c", j="_j"), "at")
        only = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        new = kept(heard.groupBy("v").agg(F.min("_c").alias("c"), only(1, "_j").alias("j"), only(2, "_c").alias("was")).select("v", "c", "j", "was"))
        dropped(state)
        state = new
        if state.filter("c < was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    half = lambda side, name: state.filter(F.col("v") % 2 == side).select(F.shiftright("v", 1).alias("v"), F.shiftright("c", 1).alias(name))
    told = kept(half(0, "c").join(half(1, "d"), "v"))
    dropped(state)
    dropped(both)
    return told


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) of every node on a cycle of edges (src, dst); the component, its strongly
    connected one, is named by its smallest id. A node on no cycle but an edge to itself is one.
    Repeated edges count once, those with a null end not at all; no edges give no rows."""
    edges = kept(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    ids = _numbers(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))))
    e = kept(_as_numbers(edges, ids))
    loops, found, levels = [e.filter("src = dst").select(F.col("src").alias("v"))], [], []
    e = kept(e.filter("src <> dst"))
    n = e.count()
    for _ in range(max_rounds):
        while n:
            less = kept(_trimmed(_trimmed(e)))
            made, members, rings = _chains(less)
            if members is None:
                e = less
            else:
                levels.append(members)
                found.append(rings.select("v", F.col("ring").alias("c")))
                loops.append(made.filter("src = dst").select(F.col("src").alias("v")))
                e = made.filter("src <> dst").select("src", "dst").distinct()
            before, n = n, e.count()
            if n > (1 - SHRINKS) * before:
                break
        if not n:
            break
        told = _least(e, max_rounds)
        one = told.filter("c = d")
        found.append(kept(one.join(one.groupBy("c").agg(F.count("*").alias("_n")).filter("_n > 1").select("c"), "c").select("v", "c")))
        rest = told.filter("c <> d")
        side = lambda end: _renamed(rest, v=end, c=f"_c_{end}", d=f"_d_{end}")
        new = kept(e.join(side("src"), "src").join(side("dst"), "dst").filter("_c_src = _c_dst and _d_src = _d_dst").select("src", "dst"))
        e, n = new, new.count()
    else:
        raise RuntimeError("strong components did not settle")
    known = found[0] if found else _renamed(loops[0], v="v").withColumn("c", F.col("v")).limit(0)
    for f in found[1:]:
        known = known.unionByName(f)
    looped = loops[0]
    for f in loops[1:]:
        looped = looped.union(f)
    looped = kept(looped.distinct())
    own = lambda k: k.unionByName(looped.join(k, "v", "left_anti").select("v", F.col("v").alias("c")))
    known = kept(known)
    for members in reversed(levels):
        of = kept(own(known))
        j = members.join(_renamed(of, v="head", c="_h"), "head").join(_renamed(of, v="tail", c="_t"), "tail")
        known = kept(known.unionByName(j.filter("_h = _t").select("v", F.col("_h").alias("c"))))
    by = own(known).join(_renamed(ids, id="id", n="v"), "v").select("id", "c")
    return by.join(by.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component")


def cycle_paths(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(component, ord, src, dst): for each strong component the edges of one cycle through its
    smallest node, in order from there and back: a shortest one, and of the nodes that may come
    before another the smallest. A node with an edge to itself gives that edge.

    Distances from the smallest node are relaxed over the graph whose chains are one edge each; the
    path back from its last node is marked by pointer doubling, 1, 2, 4 .. steps at once."""
    edges = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    comp = kept(strong_components(edges, max_rounds))
    inner = edges.join(_renamed(comp, id="src", component="k"), "src").join(_renamed(comp, id="dst", component="_k"), "dst").filter("k = _k").select("src", "dst", "k")
    inner = kept(inner)
    alone = inner.filter("src = dst and src = k").select("k", F.lit(0).cast("long").alias("ord"), "src", "dst")
    longer = kept(inner.join(alone.select("k"), "k", "left_anti").filter("src <> dst").select("src", "dst", "k"))
    ids = _numbers(longer.select(F.col("src").alias("id")).union(longer.select(F.col("dst").alias("id"))))
    e = kept(_as_numbers(longer, ids))
    roots = kept(longer.select(F.col("k").alias("id")).distinct().join(ids, "id").select(F.col("n").alias("v")))
    short, members, _ = _chains(e, roots)
    least = short.groupBy("src", "dst").agg(F.min("len").alias("len"))
    least = kept(least)
    dist = kept(roots.select("v", F.lit(0).cast("long").alias("d"), F.lit(True).alias("moved")))
    for _ in range(max(max_rounds, 1) * 1000):
        front = dist.filter("moved").select(F.col("v").alias("src"), "d")
        came = least.join(front, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("len")).alias("_m"))
        new = kept(dist.select("v", "d").join(came, "v", "full").select("v", F.least("d", "_m").alias("d"), (F.col("d").isNull() | (F.col("_m") < F.col("d"))).alias("moved")).fillna(False, ["moved"]))
        dropped(dist)
        dist = new
        if dist.filter("moved").isEmpty():
            break
    every = dist.select("v", "d")
    if members is not None:
        every = every.unionByName(members.join(_renamed(dist, v="head", d="_d"), "head").select("v", (F.col("_d") + F.col("at")).alias("d")))
    every = kept(every.join(_renamed(ids, n="v", id="id"), "v").select("id", "d"))
    # the smallest node one step nearer to the root comes before; the root has none
    near = longer.join(_renamed(every, id="src", d="_s"), "src").join(_renamed(every, id="dst", d="_d"), "dst")
    before = kept(near.filter("_d = _s + 1").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("p")))
    last = near.filter("dst = k").groupBy("k").agg(F.min(F.struct("_s", "src")).alias("e")).select("k", F.col("e.src").alias("v"), (F.col("e._s")).alias("length"))
    marked = kept(last.select("k", "v", F.lit(0).cast("long").alias("back")))
    longest = last.agg(F.max("length")).first()[0] or 0
    jump = before
    for i in range(ceil(log2(longest + 1)) if longest else 0):
        more = marked.join(jump, "v").select("k", F.col("p").alias("v"), (F.col("back") + (1 << i)).alias("back"))
        new = kept(marked.unionByName(more))
        dropped(marked)
        marked = new
        jump = kept(jump.join(_renamed(jump, v="p", p="_p"), "p").select("v", F.col("_p").alias("p")))
    path = marked.join(last.select("k", "length"), "k").join(before, "v").select("k", (F.col("length") - F.col("back") - 1).alias("ord"), F.col("p").alias("src"), F.col("v").alias("dst"))
    closing = last.select("k", F.col("length").alias("ord"), F.col("v").alias("src"), F.col("k").alias("dst"))
    return alone.unionByName(path).unionByName(closing).select(F.col("k").alias("component"), "ord", "src", "dst")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _summed(c: Column) -> list[Column]:
    """Aggregates that stand for a set of hashes in any order: sums of two runs of 15 hexadecimal
    digits, which meet in part before a shuffle however many there are."""
    part = lambda i: F.sum(F.conv(F.substring(c, i, 15), 16, 10).cast("decimal(38,0)"))
    return [part(1).alias("_a"), part(16).alias("_b"), F.count("*").alias("_c")]


def _set(prefix: str = "") -> Column:
    text = lambda c: F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)).cast("string")
    return F.concat_ws("-", text("_a"), text("_b"), text("_c"))


def transitive_fingerprints(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, fingerprint, level) of nodes (id, hash): a fingerprint changes if and only if the
    node's own hash does or that of anything that it depends on, over any number of edges (src
    depends on dst). Strong components are one: what lies on a cycle depends on all of it. Components
    are hashed from those without dependencies up, level by level, each once; a level is the longest
    way down. Edges of unknown ends are left out; a null hash counts as an empty one."""
    own = kept(nodes.filter("id is not null").groupBy("id").agg(F.min(F.coalesce("hash", F.lit(""))).alias("hash")))
    known = lambda end: own.select(F.col("id").alias(end))
    e = kept(edges.select("src", "dst").distinct().join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi"))
    comp = strong_components(e)
    of = kept(own.join(comp, "id", "left").select("id", "hash", F.coalesce("component", "id").alias("k")))
    up = e.join(_renamed(of, id="src", k="a"), "src").join(_renamed(of, id="dst", k="b"), "dst").filter("a <> b").select("a", "b").distinct()
    waits = kept(up)
    base = kept(of.groupBy("k").agg(*_summed(_digest(F.concat_ws(":", "id", "hash")))).select("k", _set().alias("own")))
    left = kept(base.join(waits.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("left")), "k", "left").select("k", "own", F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.lit(None).cast("decimal(38,0)").alias("_a"), F.lit(None).cast("decimal(38,0)").alias("_b"), F.lit(0).cast("long").alias("_c")))
    done = []
    for level in range(max_rounds):
        ready = kept(left.filter("left = 0").select("k", _digest(F.concat_ws("|", "own", _set())).alias("f"), F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done.append(ready)
        came = waits.join(_renamed(ready, k="b", f="f"), "b").groupBy(F.col("a").alias("k")).agg(*_summed(F.col("f")))
        add = lambda c: (F.coalesce(f"l.{c}", F.lit(0)) + F.coalesce(f"r.{c}", F.lit(0))).alias(c)
        new = kept(left.filter("left > 0").alias("l").join(came.alias("r"), "k", "left").select("k", "own", (F.col("left") - F.coalesce("r._c", F.lit(0))).alias("left"), add("_a").cast("decimal(38,0)").alias("_a"), add("_b").cast("decimal(38,0)").alias("_b"), add("_c").cast("long").alias("_c")))
        dropped(left)
        left = new
    else:
        raise RuntimeError("fingerprints did not settle")
    every = done[0] if done else base.select("k", F.col("own").alias("f"), F.lit(0).alias("level"))
    for d in done[1:]:
        every = every.unionByName(d)
    return of.join(every, "k").select("id", _digest(F.concat_ws("|", F.concat_ws(":", "id", "hash"), "f")).alias("fingerprint"), "level")
