"""Near copies by word shingles: MinHash bands find candidates, exact Jaccard decides.

Each text becomes the set of its shingles' hashes; equal sets are one from then on. The
smallest values of ``BANDS`` x ``ROWS`` hash functions make ``BANDS`` keys a set. Two sets of
similarity s share a key with chance 1 - (1 - s^5)^30: all but 7 in a million at 0.8.

All sets under a key are compared, but never as rows of pairs: first each with the smallest of
the key, by their texts; then, once those links are components, the sets of a key that are still
apart meet in tasks of ``TILE`` sets a side, as sketches (the ``LEAST`` smallest hashes; of a
set of no more than that, all of it). Sets that their sketches hold whole are decided there, and
a task gives out a forest of links, not their pairs. Of others, pairs whose sketches tell a similarity of
``DOUBT`` or more are compared by their texts: first a forest of these, then, where sets of a key are
still apart, all that remain. A sketch errs by 0.08 with a chance of 6 in a million.

Defined cases: texts without words share the empty set; a text of fewer words than a shingle
has one shingle; sets are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import drop_stored, stored
from .graph import star_components

#: Similarity from which two texts are near copies, as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 30, 5
STEP = 512
TILE, LEAST, DOUBT = 8_192, 512, 0.72
BIT_BYTES = 32_000_000

_RANDOM = np.random.default_rng(42)
_XOR, _TIMES = (_RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, stops)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[None, a : a + STEP] ^ _XOR) * _TIMES).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles: 64 bits, each set where over half the hashes have it."""
    sums = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        sums += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes), bitorder="little").tobytes(), "little")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of NUM / DEN or more."""
    few, many = sorted((len(x), len(y)))
    if few * DEN < many * NUM:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * DEN >= (few + many - both) * NUM


def marked(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with ``_set``, the hash of the set of shingles, its SimHash ``_fp`` and its keys
    ``_bands``."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, keys = [], [], []
            for t in b.column(b.schema.get_field_index("text")):
                s = shingles(t.as_py(), shingle)
                ids.append(xxh64_intdigest(s.tobytes(), 42))
                fps.append(majority(s))
                keys.append(bands(s))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)], lists], names=[*b.schema.names, "_set", "_fp", "_bands"])

    made = [T.StructField("_set", T.LongType()), T.StructField("_fp", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))


def linked(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those pairs (a, b) of sets whose texts are near copies. One set may be in very many
    pairs: its side is sorted, never broadcast, and its shingles are made once a run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, None
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (a, x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if a != held:
                    held, left = a, shingles(x.as_py(), shingle)
                ok[i] = alike(left, shingles(y.as_py(), shingle))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:2]], names=["a", "b"])

    side = lambda n: texts.select(F.col("_set").alias(n), F.col("text").alias(f"t{n}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def sketches(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(_set, _n, _least): the size of each set and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[:LEAST].tobytes() for x in sets], pa.binary())], names=["_set", "_n", "_least"])

    return texts.select("_set", "text").mapInArrow(run, "_set long, _n long, _least binary")


class Shared:
    """How many hashes each of a task's sets has in common with a given one. Only hashes that
    several sets have count: as bits of a row a set where these fit ``BIT_BYTES``, else from the
    list of each hash's sets."""

    def __init__(self, least: list[np.ndarray]):
        flat, size = np.concatenate(least), np.array([len(x) for x in least])
        owner, self.n = np.repeat(np.arange(len(least)), size), len(least)
        order = np.argsort(flat, kind="stable")
        _, start, many = np.unique(flat[order], return_index=True, return_counts=True)
        number = np.empty(len(flat), np.int64)
        number[order] = np.repeat(np.where(many > 1, np.cumsum(many > 1) - 1, -1), many)
        kept, wide = number >= 0, int((many > 1).sum())
        self.bits = None
        if self.n * (wide // 64 + 1) * 8 <= BIT_BYTES:
            self.bits = np.zeros((self.n, wide // 64 + 1), np.uint64)
            at = number[kept]
            np.bitwise_or.at(self.bits, (owner[kept], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            return
        self.start, self.many, self.owners = start[many > 1], many[many > 1], owner[order]
        self.first = np.cumsum(np.bincount(owner[kept], minlength=self.n))
        self.number = number[kept]

    def __call__(self, i: int) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits & self.bits[i]).sum(1, dtype=np.int64)
        h = self.number[self.first[i - 1] if i else 0 : self.first[i]]
        held = np.repeat(self.start[h] - np.cumsum(self.many[h]) + self.many[h], self.many[h]) + np.arange(self.many[h].sum())
        return np.bincount(self.owners[held], minlength=self.n)


def near_pairs(n: np.ndarray, least: list[np.ndarray], root: np.ndarray, side: np.ndarray, whole_doubt: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links of near copies, pairs in doubt) among sets of different roots and, if ``side`` has two
    values, of different sides; by the sizes and sketches of the sets. Links are a forest over the
    roots with the components of all near copies, and so are pairs in doubt, unless ``whole_doubt`` asks
    for every one between sets that the links leave apart. Sets of the commonest root need not ask."""
    size, shared = np.array([len(x) for x in least]), Shared(least)
    of = np.unique(root, return_inverse=True)[1]
    common = np.bincount(of).argmax()
    two, whole = len(np.unique(side)) > 1, n <= LEAST
    linked_, maybe = of.copy(), of.copy()  # the component of each set by links; by links and doubts
    sure, doubt = [], []
    for i in np.flatnonzero(of != common).tolist():
        both = shared(i)
        ok = (linked_ != linked_[i]) & ((of == common) | (np.arange(len(n)) > i))
        if two:
            ok &= side != side[i]
        ok &= np.minimum(n, n[i]) * DEN >= np.maximum(n, n[i]) * NUM
        exact = ok & whole & whole[i]
        near = np.flatnonzero(exact & (both * DEN >= (n + n[i] - both) * NUM))
        if len(near):
            met, first = np.unique(linked_[near], return_index=True)
            sure += [(i, j) for j in near[first].tolist()]
            for at, gone in ((maybe, maybe[near]), (linked_, met)):
                hit = np.zeros(len(n), bool)
                hit[gone] = True
                at[hit[at]] = at[i]
        for j in np.flatnonzero(ok & ~exact & (both >= DOUBT * np.minimum(size, size[i]) / 2)).tolist():
            if linked_[j] == linked_[i] or not whole_doubt and maybe[j] == maybe[i]:
                continue
            top = min(least[k][-1] for k in (i, j) if not whole[k])
            x, y = (int(np.searchsorted(least[k], top, "right")) for k in (i, j))
            if both[j] >= DOUBT * (x + y - both[j]):
                doubt.append((i, j))
                if not whole_doubt:
                    maybe[maybe == maybe[j]] = maybe[i]
    return sure, [(i, j) for i, j in doubt if linked_[i] != linked_[j]]


def _compared(whole_doubt: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets, n, root, side = (table.column(c).to_numpy() for c in ("_set", "_n", "_root", "_tile"))
        least = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("_least")]
        sure, doubt = near_pairs(n, least, root, side, whole_doubt)
        pairs = np.array([*sure, *doubt], np.int64).reshape(-1, 2)
        low, high = np.sort(sets[pairs], axis=1).T
        told = pa.array([True] * len(sure) + [False] * len(doubt), pa.bool_())
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64()), "sure": told, "_band": pa.array([key[0].as_py()] * len(told), pa.int64())})

    return run


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(_band, _set, _root, _tiles) of the keys whose sets are not all of one component."""
    rooted = members.join(roots.hint("merge"), "_set", "left").select("_band", "_set", F.coalesce("root", "_set").alias("_root"))
    apart = rooted.groupBy("_band").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), F.count("*").alias("_m")).filter("_low <> _high")
    return rooted.join(apart.select("_band", F.ceil(F.col("_m") / TILE).cast("int").alias("_tiles")).hint("merge"), "_band")


def _met(open_: DataFrame, texts: DataFrame, shingle: int, whole_doubt: bool) -> DataFrame:
    """(a, b, sure, _band) of the sets of each key, which meet in pairs of tiles."""
    told = sketches(texts.join(open_.select("_set").distinct().hint("merge"), "_set", "left_semi"), shingle)
    tile = F.pmod(F.xxhash64("_set"), F.col("_tiles")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda k: F.struct(F.least(F.col("_tile"), k).alias("_i"), F.greatest(F.col("_tile"), k).alias("_j")))
    dealt = open_.join(told.hint("merge"), "_set").withColumn("_tile", tile).select("*", F.explode(meet).alias("_p")).select("_band", "_p._i", "_p._j", "_tile", "_set", "_root", "_n", "_least")
    return dealt.groupBy("_band", "_i", "_j").applyInArrow(_compared(whole_doubt), "a long, b long, sure boolean, _band long")


def components(rows: DataFrame, shingle: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(_set, root) of every set that has near copies; ``rows`` has _row, text, _set and
    _bands and is stored. ``known`` are near copies (a, b) that need no look any more."""
    keys = rows.select(F.explode("_bands").alias("_band"), "_set")
    shared = keys.groupBy("_band").agg(F.min("_set").alias("_first"), F.max("_set").alias("_last")).filter("_first <> _last")
    members = stored(keys.join(shared.select("_band", "_first").hint("merge"), "_band").distinct())
    reps = rows.join(members.select("_set").distinct().hint("merge"), "_set", "left_semi").groupBy("_set").agg(F.min("_row").alias("_row"))
    texts = stored(rows.select("_row", "_set", "text").join(reps.select("_row").hint("merge"), "_row", "left_semi").select("_set", "text"))
    star = members.filter("_set <> _first").select(F.col("_first").alias("a"), F.col("_set").alias("b")).distinct()
    if known is not None:
        star = star.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
    links = linked(star, texts, shingle)
    links = stored(links if known is None else links.unionByName(known))
    named = lambda found: found.select(F.col("node").alias("_set"), "root")
    open_ = stored(_apart(members.filter("_set <> _first").select("_band", "_set"), named(star_components(links))))
    pairs = stored(_met(open_, texts, shingle, False))
    doubt = stored(pairs.filter("not sure").select("a", "b").distinct())
    links = links.unionByName(pairs.filter("sure").select("a", "b")).unionByName(stored(linked(doubt, texts, shingle)))
    found = named(star_components(links))
    if not doubt.isEmpty():
        # doubts were a forest: where its links leave a key's sets apart, all others are looked at
        again = pairs.filter("not sure").select("_band").distinct().hint("merge")
        left = stored(_apart(open_.select("_band", "_set").join(again, "_band", "left_semi"), found))
        rest = stored(_met(left, texts, shingle, True).filter("not sure").select("a", "b").distinct().join(doubt.hint("merge"), ["a", "b"], "left_anti"))
        more = stored(linked(rest, texts, shingle))
        found = named(star_components(links.unionByName(more)))
        for done in (left, rest, more):
            drop_stored(done)
    for done in (members, texts, links, open_, pairs, doubt):  # the components are stored
        drop_stored(done)
    return found
