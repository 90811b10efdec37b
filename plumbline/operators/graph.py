"""Dependency graphs: build, resolve, statistics, components, cycles, reach, exports."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from .cycles import strong_components
from .storage import dropped, kept, numbered

KINDS = ("module", "function", "data_type", "io")


def _edge_kinds(callee) -> tuple:
    """(kind, name) of a callee: ``CALL:`` and ``GOTO:`` prefixes become the edge's kind."""
    kind = F.when(callee.startswith("CALL:"), "call").when(callee.startswith("GOTO:"), "goto").otherwise("calls")
    return kind, F.regexp_replace(callee, "^(CALL|GOTO):", "")


def first_functions(functions: DataFrame) -> DataFrame:
    """(name, id): of functions with one name that of the first module, in order of ``ord``
    where there is such a column, else by name."""
    by = F.struct("ord", "module") if "ord" in functions.columns else F.col("module")
    made = functions.withColumn("id", F.concat(F.lit("fn:"), "module", F.lit("."), "name"))
    return made.groupBy("name").agg(F.min_by("id", by).alias("id"))


def build(functions: DataFrame, data_types: DataFrame, io: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, name, module), first wins, and edges (src, dst, kind). A callee is the
    function of that name in the first module that has one, else unknown in the caller's module."""
    fn = functions.select("module", "name", F.concat(F.lit("fn:"), "module", F.lit("."), "name").alias("id"), "calls")
    calls = fn.select("id", "module", F.explode("calls").alias("c"))
    kind, callee = _edge_kinds(F.col("c"))
    calls = calls.select("id", "module", kind.alias("kind"), callee.alias("callee"))
    first = first_functions(functions).select(F.col("name").alias("_f"), F.col("id").alias("_first"))
    j = calls.join(first, calls.callee == first._f, "left")
    edges = j.select(F.col("id").alias("src"), F.coalesce("_first", F.concat(F.lit("fn:"), "module", F.lit("."), "callee")).alias("dst"), "kind")
    mod = F.concat(F.lit("mod:"), "module")
    dt, ioid = F.concat(F.lit("dt:"), "module", F.lit("."), "name"), F.concat(F.lit("io:"), "module", F.lit("."), "name")
    edges = edges.unionByName(fn.select(mod.alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind")))
    edges = edges.unionByName(data_types.select(mod.alias("src"), dt.alias("dst"), F.lit("contains").alias("kind"))).unionByName(io.select(mod.alias("src"), ioid.alias("dst"), F.lit("io").alias("kind")))
    made = functions.select("module").union(data_types.select("module")).union(io.select("module")).distinct()
    nodes = made.select(mod.alias("id"), F.lit("module").alias("kind"), F.col("module").alias("name"), "module", F.lit(0).alias("_o"))
    nodes = nodes.union(fn.select("id", F.lit("function"), "name", "module", F.lit(1)))
    nodes = nodes.union(edges.filter("kind in ('calls', 'call', 'goto')").select("dst", F.lit("function"), F.regexp_extract("dst", r"^fn:[^.]*\.(.*)$", 1), F.regexp_extract("dst", r"^fn:([^.]*)", 1), F.lit(2)))
    nodes = nodes.union(data_types.select(dt, F.lit("data_type"), "name", "module", F.lit(3))).union(io.select(ioid, F.lit("io"), "name", "module", F.lit(4)))
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("kind", "name", "module"), "_o").alias("n")).select("id", "n.*")
    return nodes, edges


def add_absent(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges, and those of ``more`` that are not among them by source, target and kind; each of
    these once."""
    keys = ["src", "dst", "kind"]
    return edges.unionByName(more.select(*keys).distinct().join(edges.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def merge_calls(edges: DataFrame, functions: DataFrame, call_graph: DataFrame) -> DataFrame:
    """Edges with those of a global call graph (caller, callee) that are absent. A name is the
    function of the first module that has it, else ``fn:unknown.<name>``; no nodes are made."""
    first = first_functions(functions)

    def found(df: DataFrame, name: str, to: str) -> DataFrame:
        f = first.select(F.col("name").alias(name), F.col("id").alias("_id"))
        return df.join(f, name, "left").withColumn(to, F.coalesce("_id", F.concat(F.lit("fn:unknown."), F.col(name)))).drop("_id")

    kind, callee = _edge_kinds(F.col("callee"))
    named = call_graph.select("caller", kind.alias("kind"), callee.alias("callee"))
    return add_absent(edges, found(found(named, "caller", "src"), "callee", "dst").select("src", "dst", "kind"))


def with_module_edges(edges: DataFrame) -> DataFrame:
    """Edges and a ``depends_on`` edge for each pair of different modules that call each other."""
    calls = edges.filter(F.col("kind").isin("calls", "call", "goto"))
    module = lambda c: F.concat(F.lit("mod:"), F.col(c)).alias(c)
    return edges.unionByName(module_edges(calls).filter("src <> '' and dst <> ''").select(module("src"), module("dst"), F.lit("depends_on").alias("kind")))


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row; the hotspot is the node of the largest fan-out, smallest id among equals (none
    without edges)."""
    best = _degrees(edges).agg(F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"), F.coalesce(F.max("fan_in"), F.lit(0)).alias("max_fan_in"), F.min_by("id", F.struct(-F.col("fan_out"), F.col("id"))).alias("hotspot"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS] if "kind" in nodes.columns else []
    n = nodes.agg(F.count("*").alias("n_nodes"), *kinds)
    e = edges.agg(F.count("*").alias("n_edges"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(n).join(one(e), "_k").join(one(best), "_k").drop("_k")


def module_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, a count of nodes of each kind, fan_out: other modules it depends on)."""
    own = nodes.groupBy("module").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    out = module_edges(edges.filter(F.col("kind").isin("calls", "call", "goto"))).groupBy(F.col("src").alias("module")).agg(F.count("*").alias("fan_out"))
    return own.join(out, "module", "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (ord, line) of a summary: counts, fan-out and fan-in, components, nodes on cycles,
    and what each module depends on."""
    s = stats(nodes, edges).first()
    n = components(nodes, edges).select("component").distinct().count()
    cyclic = strong_components(edges).count()
    lines = [f"nodes {s['n_nodes']}", *[f"  {k} {s[f'n_{k}']}" for k in KINDS], f"edges {s['n_edges']}", f"max fan-out {s['max_fan_out']} ({s['hotspot']})", f"max fan-in {s['max_fan_in']}", f"components {n}", f"nodes on cycles {cyclic}"]
    head = nodes.sparkSession.createDataFrame([(i, "", x) for i, x in enumerate(lines)], "part int, k string, line string")
    mods = module_stats(nodes, edges).filter("fan_out > 0").select(F.lit(len(lines)).alias("part"), F.col("module").alias("k"), F.concat_ws(" ", F.lit("module"), "module", "fan_out").alias("line"))
    return head.unionByName(mods).select(F.struct("part", "k").alias("ord"), "line")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable without regard to direction. Ids become
    numbers in their order, over which large and small stars alternate: every node links to the
    smallest neighbour of its neighbours' until all are stars, after about the logarithm of the
    longest path. Each round is written to the shared folder and the one before deleted."""
    ids = nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
    rank = kept(numbered(ids, "id", "n"))
    end = lambda c, to: rank.select(F.col("id").alias(c), F.col("n").alias(to))
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = kept(edges.select("src", "dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst").select(*pair(F.col("a"), F.col("b"))).filter("u <> v").distinct())
    said = None
    for _ in range(max_rounds):
        low = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = kept(small.select(*pair(F.col("v"), F.col("m"))).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if now == said:
            break
        said = now
    else:
        raise RuntimeError("components did not settle")
    up = e.groupBy("u").agg(F.min("v").alias("v"))
    of = rank.join(up, rank.n == up.u, "left").select("id", F.coalesce("v", "n").alias("r"))
    names = rank.select(F.col("n").alias("r"), F.col("id").alias("component"))
    return of.join(names, "r").select("id", "component")


def module_edges(edges: DataFrame) -> DataFrame:
    m = lambda c: F.regexp_extract(c, r"^(?:fn|dt|io|mod):([^.]*)", 1)
    return edges.select(m("src").alias("src"), m("dst").alias("dst")).filter("src <> dst").distinct()


def reach(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): everything reachable within max_depth steps (None: any number of
    steps, until no new pair is found), shortest depth. Each step joins the frontier alone and drops pairs already known."""
    e = edges.select("src", "dst").distinct()
    known = kept(e.withColumn("depth", F.lit(1)))
    front = known
    for d in count(2) if max_depth is None else range(2, max_depth + 1):
        nxt = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("to")), "mid").select("src", F.col("to").alias("dst")).distinct()
        front = kept(nxt.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def on_cycle(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, length) of nodes that lie on a cycle of at most max_depth edges, with their shortest
    one; all pairs in reach are made, so give a depth on large graphs. ``cycles.strong_components``
    tells which nodes lie on any cycle without them, ``cycles.cycle_paths`` a cycle of each."""
    return reach(edges, max_depth).filter("src = dst").select(F.col("src").alias("id"), F.col("depth").alias("length"))


def callees(edges: DataFrame, src: str) -> DataFrame:
    return edges.filter((F.col("src") == src) & F.col("kind").isin("calls", "call", "goto")).select("dst")


#: How nodes and edges are drawn.
SHAPES = {"module": "box3d", "function": "box", "data_type": "ellipse", "io": "diamond"}
FILLS = {"module": "#1f6feb", "function": "#238636", "data_type": "#8957e5", "io": "#d29922"}
STYLES = {"calls": "solid", "contains": "dashed", "uses": "dotted", "io": "bold", "depends_on": "bold"}
COLORS = {"calls": "#3fb950", "contains": "#8b949e", "uses": "#8957e5", "io": "#d29922", "depends_on": "#f85149"}
OPENS = {"module": '[["', "function": '["', "data_type": '(["', "io": '{"'}
CLOSES = {"module": '"]]', "function": '"]', "data_type": '"])', "io": '"}'}
ARROWS = {"calls": "-->", "contains": "-.->", "uses": "-..->", "io": "==>", "depends_on": "===>"}


def _case(kind, values: dict, other: str):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _clustered(nodes: DataFrame, begin, node, end: str) -> DataFrame:
    """(part, k, n, line): for each module a first line, one for each node, and a last line."""
    mods = nodes.select("module").distinct()
    row = lambda n, line: (F.lit(1).alias("part"), F.col("module").alias("k"), n.alias("n"), line.alias("line"))
    return mods.select(*row(F.lit("0"), begin)).union(nodes.select(*row(F.concat(F.lit("1"), "id"), node))).union(mods.select(*row(F.lit("2"), F.lit(end))))


def _lines(rows: DataFrame, head: list[str], tail: list[str]) -> DataFrame:
    ends = [(0, "", f"{i:02d}", x) for i, x in enumerate(head)] + [(3, "", f"{i:02d}", x) for i, x in enumerate(tail)]
    made = rows.sparkSession.createDataFrame(ends, "part int, k string, n string, line string")
    return rows.union(made).select(F.struct("part", "k", "n").alias("ord"), "line")


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The DOT text of a graph, one row per line (ord, line): nodes in a cluster for each module,
    then the edges with a style for each kind."""
    kind, safe = F.col("kind"), F.regexp_replace("module", "[^A-Za-z0-9_]", "_")
    begin = F.concat(F.lit("  subgraph cluster_"), safe, F.lit(' { label="'), "module", F.lit('"; style=dashed; color="#58a6ff";'))
    node = F.format_string('    "%s" [label="%s" shape=%s style=filled fillcolor="%s"];', "id", "name", _case(kind, SHAPES, "box"), _case(kind, FILLS, "#30363d"))
    edge = F.format_string('  "%s" -> "%s" [style=%s color="%s"];', "src", "dst", _case(kind, STYLES, "solid"), _case(kind, COLORS, "#c9d1d9"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(">", "src", "dst").alias("k"), kind.alias("n"), edge.alias("line"))
    return _lines(_clustered(nodes.filter("kind <> 'module'"), begin, node, "  }").union(e), ["digraph dependencies {", "  rankdir=LR;"], ["}"])


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The Mermaid text of a graph, one row per line (ord, line)."""
    kind, safe = F.col("kind"), lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    node = F.concat(F.lit("    "), safe("id"), _case(kind, OPENS, '["'), "name", _case(kind, CLOSES, '"]'))
    edge = F.concat(F.lit("  "), safe("src"), F.lit(" "), _case(kind, ARROWS, "-->"), F.lit(" "), safe("dst"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(">", "src", "dst").alias("k"), kind.alias("n"), edge.alias("line"))
    return _lines(_clustered(nodes, F.concat(F.lit("  subgraph "), safe("module")), node, "  end").union(e), ["graph LR"], [])


def to_json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as JSON lines (kind of line, json): a row a node and an edge, so that none is
    gathered."""
    one = lambda df, what: df.select(F.lit(what).alias("what"), F.to_json(F.struct(*df.columns)).alias("json"))
    return one(nodes, "node").unionByName(one(edges, "edge"))


# ---- a store of graphs ----------------------------------------------------------------


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store's rows with those of ``new`` in place of equal keys; of several new rows with
    one key the last in order of its other columns counts. Null keys match each other."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else new.select(*keys).distinct()
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return store.alias("s").join(one.select(*keys).alias("n"), on, "left_anti").unionByName(one, allowMissingColumns=True)


def load_modules(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, path, language, functions): each module with the names of its functions in order;
    one without functions has an empty list."""
    by = functions.groupBy(F.col("module").alias("name")).agg(F.array_sort(F.collect_set("function")).alias("functions"))
    return modules.join(by, "name", "left").withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))


def first_match(names: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return names.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").select(key, value)
