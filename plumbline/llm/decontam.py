"""Operator 8: benchmark decontamination by a distributed positional inverted index.

``index`` cuts the corpus into blocks of documents and stores, for each block, its dictionary
of words, how often each occurs, and the positions of every occurrence of every word, grouped
by word. So a word's posting list is split by document range: a word in every document is one
stretch a block, and no task holds more than a block's. The index knows nothing of a benchmark
and serves any number of them.

A search reads the dictionaries and counts once, which tells how rare each test term is in the
whole corpus, then the postings once. Items become windows of ``WINDOW`` words (a shorter item
is one window). In a block, the list of a window's rarest term, moved back by its offset, gives
candidate starts; the lists of its other terms, each moved by its own offset, are intersected
with them from rare to frequent. What is left are exact phrase matches. Proximity matches start
from the terms one of which every match must hold (one more than a match may lack, the rarest
ones) and keep the places around which ``NEAR`` tenths of the window's terms lie in any order.

Test terms go to the workers in blocks of at most about ``ITEM_WORDS`` words; a larger benchmark
is searched block after block over the same index. Every count is over all documents; nothing
is capped, and words are compared as bytes.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has
no windows; an item id that repeats counts once; a null item id is not listed, but the words
that its windows hit count; repeated rows, and rows with one doc_id or none, are judged one by
one; other columns are kept; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, packed, squeezed, stored, unpacked, unsqueezed

WINDOW = 10
NEAR = 8
BLOCK_BYTES = 8_000_000
ITEM_WORDS = 500_000
CANDIDATES = 1_000_000  # places looked at together
#: Bytes of a word stay (A-Z as a-z), all other ASCII becomes a space.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


# ---- the index ------------------------------------------------------------------------


def _indexed(keep: list[str]):
    """A block's row: its documents with where each begins, and its posting lists. Between two
    documents ``WINDOW`` positions are left free, so that no window reaches across."""

    def make(number: int, rows: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        found = [np.fromiter(map(ids.__getitem__, w), np.int32, len(w)) for w in map(words, rows.column("text").to_pylist())]
        sizes = np.array([len(x) for x in found], np.int64)
        first = np.cumsum(sizes + WINDOW) - sizes - WINDOW
        term = np.concatenate([np.zeros(0, np.int32), *found])
        at = np.arange(len(term)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        order = np.argsort(term, kind="stable")
        arrays = [rows.column(c).combine_chunks() for c in keep] + [pa.array(sizes), pa.array(first)]
        docs = pa.StructArray.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=[*keep, "n_words", "first"])
        return pa.table(
            {
                "block": pa.array([number], pa.int64()),
                "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                "terms": pa.array([squeezed(b" ".join(ids))], pa.binary()),
                "counts": pa.array([squeezed(np.bincount(term, minlength=len(ids)).astype(np.uint32).tobytes())], pa.binary()),
                "postings": pa.array([squeezed(np.diff(at[order], prepend=0).astype(np.int32).tobytes())], pa.binary()),
            }
        )

    return make


def index(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The stored index of ``docs``; ``keep`` names the columns that its documents carry."""
    row = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("first", T.LongType())])
    fields = [T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(row))]
    schema = T.StructType(fields + [T.StructField(n, T.BinaryType()) for n in ("terms", "counts", "postings")])
    return stored(blocks(docs.select(*dict.fromkeys([*keep, "text"])), BLOCK_BYTES, "text", _indexed(keep), schema))


class Lists:
    """Those posting lists of a block that belong to test terms, as one sorted array of keys:
    the term's id, then the position."""

    def __init__(self, vocabulary: dict[bytes, int], terms: bytes, counts: bytes, postings: bytes):
        get = vocabulary.get
        held = unsqueezed(terms).split(b" ")
        n = np.frombuffer(unsqueezed(counts), np.uint32).astype(np.int64)
        term = np.fromiter((get(w, -1) for w in held), np.int64, len(held))[: len(n)]
        at = np.cumsum(np.frombuffer(unsqueezed(postings), np.int32), dtype=np.int64)
        mine = np.flatnonzero(term >= 0)
        mine = mine[np.argsort(term[mine])]
        self.n = np.zeros(len(vocabulary) + 1, np.int64)
        self.n[term[mine]] = n[mine]
        self.start = np.cumsum(self.n) - self.n
        self.keys = term[mine].repeat(n[mine]) << 32 | at[stretches(np.cumsum(n)[mine] - n[mine], n[mine])]

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms, position) of all their occurrences."""
        return np.repeat(np.arange(len(terms)), self.n[terms]), self.keys[stretches(self.start[terms], self.n[terms])] & 0xFFFFFFFF

    def holds(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a position within low..high."""
        i = np.searchsorted(self.keys, terms << 32 | np.maximum(low, 0))
        out = i < len(self.keys)
        out[out] = self.keys[i[out]] <= (terms << 32 | high)[out]
        return out


def stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n places each, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


# ---- searching it ---------------------------------------------------------------------


class Windows:
    """The windows of a block of items: their terms in order of place and of rarity."""

    def __init__(self, items: list):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in sorted(items, key=lambda x: (str(x[0]), x[1] or "")):  # ids, and so ties, are the same in any order of rows
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words(text)]
            n = min(WINDOW, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                found.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.items = [sorted(str(x) for x in s if x is not None) for s in found.values()]
        self.terms = list(found)

    def ranked(self, n: np.ndarray) -> None:
        """Orders each window's terms by how often they occur in the corpus: the places of all
        (-1: none), and the distinct ones (-1: none) with how many a near match may lack."""
        m = len(self.terms)
        self.size = np.array([len(w) for w in self.terms], np.int64)
        self.term, self.place, self.distinct = (np.full((m, WINDOW), -1, np.int64) for _ in range(3))
        self.lacks = np.zeros(m, np.int64)
        for k, w in enumerate(self.terms):
            by = sorted(range(len(w)), key=lambda i: (n[w[i]], w[i], i))
            self.place[k, : len(w)] = by
            self.term[k, : len(w)] = [w[i] for i in by]
            own = list(dict.fromkeys(w[i] for i in by))
            self.distinct[k, : len(own)] = own
            self.lacks[k] = len(own) * (WINDOW - NEAR) // WINDOW

    def _rounds(self, lists: Lists, wins: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its term) in parts of about CANDIDATES."""
        total = np.cumsum(lists.n[terms])
        a = 0
        while a < len(wins):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES, "right")))
            which, at = lists.places(terms[a:b])
            yield wins[a:b][which], at
            a = b

    def exact(self, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every phrase match."""
        there = (lists.n[self.term] > 0) | (self.term < 0)
        wins, out = np.flatnonzero(there.all(1)), [(np.zeros(0, np.int64),) * 2]
        for win, at in self._rounds(lists, wins, self.term[wins, 0]):
            start = at - self.place[win, 0]
            win, start = win[start >= 0], start[start >= 0]
            for k in range(1, WINDOW):
                more = np.flatnonzero(self.term[win, k] >= 0)
                at = start[more] + self.place[win[more], k]
                gone = more[~lists.holds(self.term[win[more], k], at, at)]
                win, start = np.delete(win, gone), np.delete(start, gone)
            out.append((win, start))
        return tuple(map(np.concatenate, zip(*out)))

    def near(self, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of a rare term of it) of every proximity match."""
        absent = ((self.distinct >= 0) & (lists.n[self.distinct] == 0)).sum(1)
        out = [(np.zeros(0, np.int64),) * 2]
        for k in range(int(self.lacks.max(initial=-1)) + 1):
            wins = np.flatnonzero((absent <= self.lacks) & (k <= self.lacks) & (self.distinct[:, k] >= 0))
            for win, at in self._rounds(lists, wins, self.distinct[wins, k]):
                lacked = np.zeros(len(win), np.int64)
                for j in range(WINDOW):
                    more = np.flatnonzero(self.distinct[win, j] >= 0)
                    lacked[more] += ~lists.holds(self.distinct[win[more], j], at[more] - WINDOW + 1, at[more] + WINDOW - 1)
                    stay = lacked <= self.lacks[win]
                    win, at, lacked = win[stay], at[stay], lacked[stay]
                out.append((win, at))
        return tuple(map(np.concatenate, zip(*out)))


def item_blocks(items: DataFrame) -> Iterator[list]:
    """The items, in blocks of about ``ITEM_WORDS`` words."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (4 * ITEM_WORDS)) or 1
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()


def term_counts(indexed: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each term in all documents, from the dictionaries alone."""
    known = indexed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        n = np.zeros(len(v) + 1, np.int64)
        for b in batches:
            for terms, counts in zip(b.column(0), b.column(1)):
                held, c = unsqueezed(terms.as_py()).split(b" "), np.frombuffer(unsqueezed(counts.as_py()), np.uint32)
                n += np.bincount(np.fromiter((v.get(w, -1) for w in held), np.int64, len(held))[: len(c)] + 1, c, len(n)).astype(np.int64)
        hit = np.flatnonzero(n[1:])
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(n[1:][hit])], names=["term", "n"])

    rows = indexed.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


_FOUND = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("items", "near")]]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that intervals cover; ones that touch stay apart only across a gap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, np.int64)
    return start[new], end[np.append(new, len(start))[1:] - 1]


def search(indexed: DataFrame, items: list) -> DataFrame:
    """(block, ord, the documents' columns, n_words, spans, items, near) of every document:
    the words hit by exact matches, the items that have them, and those with any match."""
    windows = Windows(items)
    windows.ranked(term_counts(indexed, windows.vocabulary) if windows.vocabulary else np.zeros(0, np.int64))
    said = indexed.sparkSession.sparkContext.broadcast(windows)
    row = indexed.schema["docs"].dataType.elementType
    keep = [f for f in row.fields if f.name != "first"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ord", T.LongType()), *keep, *_FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = said.value
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                docs = part.column("docs").flatten()
                first = docs.field("first").to_numpy(zero_copy_only=False)
                lists = Lists(w.vocabulary, *(part.column(c)[0].as_py() for c in ("terms", "counts", "postings")))
                spans, hit, near = [[] for _ in first], [set() for _ in first], [set() for _ in first]
                win, start = w.exact(lists)
                for of, into in ((w.near(lists), (near,)), ((win, start), (hit, near))):
                    pairs = np.unique(np.stack([np.searchsorted(first, of[1], "right") - 1, of[0]], 1), axis=0)
                    for d, k in pairs.tolist():
                        for x in into:
                            x[d].update(w.items[k])
                begin, end = merged(start, start + w.size[win])
                for d, x, y in zip((np.searchsorted(first, begin, "right") - 1).tolist(), begin.tolist(), end.tolist()):
                    spans[d].append({"start": x - int(first[d]), "end": y - int(first[d])})
                n = len(first)
                arrays = [pa.array([part.column("block")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), *[docs.field(f.name) for f in keep], pa.array(spans, _SPANS)]
                arrays += [pa.array([sorted(x) for x in s], pa.list_(pa.string())) for s in (hit, near)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return indexed.mapInArrow(run, schema)


def judged(docs: DataFrame, items: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked for), n_words, n_hit, items, n_near (items
    with proximity matches alone), contaminated."""
    made = ("n_words", "n_hit", "items", "n_near", "contaminated")
    names = [c for c in docs.columns if c not in made and (with_text or c != "text")]
    rows = packed(docs.drop(*made), "doc_id", "text")
    keep = [c for c in rows.columns if with_text or c != "text"]
    indexed = index(rows, keep)
    parts = [search(indexed, block) for block in item_blocks(items)]
    found = parts[0]
    if len(parts) > 1:  # every part has a row for each document
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        merge = [F.first(c).alias(c) for c in (*keep, "n_words")] + [F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")]
        merge += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")]
        found = every.groupBy("block", "ord").agg(*merge)
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    return unpacked(found, names, "n_words", hit.alias("n_hit"), "items", (F.size("near") - F.size("items")).cast("long").alias("n_near")).withColumn("contaminated", F.col("n_hit") > 0)


def digests(found: DataFrame, *more: str) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", *more)
