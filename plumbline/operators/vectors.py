"""Vector store: upsert and top-k search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.scalars import cosine

from .storage import dealt, kept


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def top_k(store: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """The k most similar rows; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.select(key, F.round(cosine(F.col(vector), q), 5).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Cells of the store: about the root of its rows, in these bounds; rows of a sample that centres are
#: chosen from; rounds that move them.
CELLS, SAMPLE, ROUNDS = (1, 4096), 20_000, 4
#: Rows of the store and queries that a task compares, at most about, and scores that it holds at once.
TASK_ROWS, TASK_QUERIES, BLOCK = 50_000, 100_000, 4_000_000
#: A vector's unit vector is this much longer or shorter at most: bounds give way by it.
SLACK = 1e-6


def _unit(vector: str):
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.col(vector), lambda x: x.cast("double") / size)


def _usable(df: DataFrame, id_: str, vector: str, d: int | None) -> DataFrame:
    """(id, unit vector) of rows with finite entries, some length over 0 and dimension ``d``."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))) & F.exists(F.col(vector), lambda c: c != 0)
    rows = df.filter(F.col(vector).isNotNull() & whole)
    rows = rows if d is None else rows.filter(F.size(vector) == d)
    return rows.select(F.col(id_).alias("_id"), _unit(vector).alias("_v"))


def _centres(units: DataFrame, n: int):
    """Unit centres of cells, moved over a bounded sample of the rows."""
    import numpy as np

    k = int(min(max(CELLS[0], round(n**0.5)), CELLS[1]))
    share = min(1.0, 2.0 * SAMPLE / max(n, 1))
    picked = units.filter(F.pmod(F.xxhash64("_v"), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("_v"), "_v").limit(SAMPLE)
    x = picked.select("_v").toArrow().column(0).combine_chunks()
    if not len(x) and share < 1:  # few rows of a large store are usable
        x = units.orderBy(F.xxhash64("_v"), "_v").limit(SAMPLE).select("_v").toArrow().column(0).combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
    if not len(x):
        return x
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1))
        c = np.where((size > 0)[:, None], sums / np.where(size > 0, size, 1)[:, None], c)
    return c


def _matrix(column):
    """A column of vectors of one length, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bins(centres, sizes: list[tuple[int, int]], cores: int) -> dict[int, tuple[int, int]]:
    """The first bin of each cell (number, rows), and of how many it is: bins of like size, four a core
    or more, cells around like centres in one."""
    import numpy as np

    rows = min(TASK_ROWS, max(1, -(-sum(n for _, n in sizes) // (4 * cores))))
    heads = centres[:: max(1, round(len(centres) ** 0.5))]
    group = (centres @ heads.T).argmax(1)
    of, number, held = {}, 0, 0
    for cell, n in sorted(sizes, key=lambda c: (group[c[0]], c[0])):
        if held and held + n > rows:
            number, held = number + 1, 0
        of[cell] = (number, -(-n // rows))
        held += n
        if of[cell][1] > 1:
            number, held = number + of[cell][1], 0
    return of


def _best(k: int):
    """The k best rows of each query (score of five digits, ties by id) of a group of rows and one of queries."""

    def run(rows, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows, [("_id", "ascending")], null_placement="at_start"))
        n, found = rows.num_rows, [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if n and asked.num_rows:
            x, w = _matrix(rows["_v"].combine_chunks()), _matrix(asked["_w"].combine_chunks())
            step = max(1, BLOCK // n)
            for i in range(0, len(w), step):
                s = w[i : i + step] @ x.T
                s = np.copysign(np.floor(np.abs(s) * 1e5 + 0.5) / 1e5, s) + 0.0  # halves away from 0, no -0
                least = np.partition(s, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
                q, r = np.nonzero(s >= least)
                order = np.lexsort((r, -s[q, r], q))
                q, r = q[order], r[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append((q[first] + i, r[first], s[q[first], r[first]]))
        q, r, score = (np.concatenate(c) for c in zip(*found))
        return pa.table([asked["_q"].take(pa.array(q)), rows["_id"].take(pa.array(r)), pa.array(score)], names=["_q", "_id", "score"])

    return run


def search(store: DataFrame, queries: DataFrame, query: str, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score): the k most similar rows of each query by cosine similarity (rounded to
    five digits, ties by key), exactly, for any number of queries.

    The store's unit vectors are dealt to cells around centres; a cell knows the largest
    angle of its rows to its centre. By the triangle inequality a row's angle to a query is at least
    the query's to the centre less the cell's largest, and at most their sum: a query's k nearest
    lie within the distance at which cells known to hold k rows end. Cells near each other share a bin, the
    rows of a task; a cell that holds many rows is dealt to bins of its own. Queries go, as rows, once to
    each bin with a cell that reaches into that distance, and meet the rows there as matrices; the k
    best of each bin and query meet by query. Where vectors lie so evenly that no cell is out of reach, all
    pairs are compared, bin by bin.

    A null vector, one with a null or an infinite entry, or of no length matches nothing; a row
    matches queries of its own dimension only (the queries' most frequent one; others match nothing)."""
    import numpy as np

    sized = queries.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("_d")).agg(F.count("*").alias("_n")).agg(F.max_by("_d", F.struct("_n", "_d")).alias("_d")).first()
    id_type, key_type = queries.schema[query].dataType.simpleString(), store.schema[key].dataType.simpleString()
    schema = f"{query} {id_type}, {key} {key_type}, score double"
    d = sized["_d"] if sized else None
    rows, asked = _usable(store, key, vector, d or 0), _usable(queries, query, vector, d or 0)
    centres = _centres(rows, store.count()) if d else ()
    if not len(centres):
        return store.sparkSession.createDataFrame([], schema)
    told = store.sparkSession.sparkContext.broadcast(centres)  # at most CELLS[1] vectors

    def placing(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                s = x @ told.value.T
                cell = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(x)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["_id", "_v", "_cell", "_angle"])

    rows = _usable(dealt(store.select(key, vector), key), key, vector, d)
    placed = kept(rows.mapInArrow(placing, f"_id {key_type}, _v array<double>, _cell int, _angle double"))
    bounds = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_angle").alias("far")).collect()  # a row for each cell
    of = _bins(centres, [(r["_cell"], r["n"]) for r in bounds], store.sparkSession.sparkContext.defaultParallelism)
    cells = store.sparkSession.sparkContext.broadcast(sorted((r["_cell"], r["n"], r["far"], *of[r["_cell"]]) for r in bounds))

    def sent(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, size, far, start, parts = (np.array(c) for c in zip(*cells.value))
        for b in batches:
            at, bins = [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else ()):
                angle = np.arccos(np.clip(told.value[number] @ q, -1, 1))
                order = np.argsort(angle + far)
                enough = min(int(np.searchsorted(np.cumsum(size[order]), k)), len(order) - 1)
                limit = (angle + far)[order[enough]] + SLACK + 0.01  # scores are rounded: equal ones may lie a little further
                near = np.flatnonzero(angle - far <= limit)
                to = np.unique(np.concatenate([start[near], *(np.arange(start[c], start[c] + parts[c]) for c in near[parts[near] > 1])]))
                at.append(np.full(len(to), i))
                bins.append(to)
            if at:
                here = pa.array(np.concatenate(at), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(here), b.column(1).take(here), pa.array(np.concatenate(bins), pa.int64())], names=["_q", "_w", "_bin"])

    asked = kept(asked)
    blocks = -(-asked.count() // TASK_QUERIES) or 1
    going = dealt(asked, "_id").mapInArrow(sent, f"_q {id_type}, _w array<double>, _bin long").withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)))
    places = F.broadcast(store.sparkSession.createDataFrame([(c, *of[c]) for c in of], "_cell int, _start long, _of long"))
    spread = placed.join(places, "_cell").select("_id", "_v", (F.col("_start") + F.pmod(F.xxhash64("_id"), F.col("_of"))).alias("_bin"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("_block"))
    best = spread.groupBy("_bin", "_block").cogroup(going.groupBy("_bin", "_block")).applyInArrow(_best(k), f"_q {id_type}, _id {key_type}, score double")
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "_id"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= k).select(F.col("_q").alias(query), F.col("_id").alias(key), "score")
