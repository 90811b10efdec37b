"""Operator 7: exact removal of byte strings that also start in an earlier document.

Anchors deal the texts out to shards; each shard's suffixes are sorted externally by
induction (``suffixes``), with their common prefixes, and decide.

A string of ``K`` bytes holds ``K - G + 1`` grams of ``G`` bytes. The places of the smallest
gram hash of each such string are anchors: equal strings have equal anchors at equal offsets,
so all places of a string meet in the shard that owns its anchor's gram.

0. Rows are cut into blocks, written once to the shared folder with the places of their anchors;
   every later step reads these there and only hashes the anchors' own grams again.
1. Each block sends every distinct anchor hash once to the shard that owns it, which answers
   whether another document has it too.
2. For shared anchors, each block sends the distinct contexts (all bytes of any string that
   holds the anchor) with the smallest doc_id to the shard that owns the gram.
3. A context that agrees with no other on its gram and enough of its sides repeats only as a
   whole, which its smallest doc_id settles. The shard's text is its other distinct contexts,
   each ended by a separator. Its suffixes come in order, with common prefixes up to ``K``; a
   run of ``K`` is one string, and its smallest doc_id goes back to every start in it.
4. Each block marks the starts whose smallest doc_id is below its own document's, and removes
   every byte they cover.

A passage in a third of all documents is one context a block; nothing is capped or broadcast.
A block looks only at the shards that it sends to, so the work follows the input's size.

Defined cases: null text counts as empty; texts under ``K`` bytes lose nothing; rows with one
doc_id are one document and never remove each other's bytes; null doc_ids come after all
others; doc_id is of an integer type or casts to long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BlockFiles, drop_folder, shared_dir, squeezed, stored, unsqueezed
from .suffixes import Spill, sorted_suffixes

K, G = 50, 24
SIDE = K - G  # bytes of context on either side of an anchor's gram
BLOCK_BYTES = 8_000_000
SHARD_ANCHORS = 1_100_000  # that a shard owns: those of about 16 MB of text
QUEUE_BYTES, NAME_BYTES = 16_000_000, 256_000_000  # of a sort in memory (see Spill)
STEP = 1 << 16  # places hashed at a time, so that the arrays stay in the processor's cache
LAST = np.iinfo(np.int64).max


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each G bytes, given as three 64-bit words."""
    x = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for w, c in zip(words[1:], (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        x = (x ^ (x >> np.uint64(31))) + w * np.uint64(c)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """The hash of the G bytes from every place (beyond the end: of zero bytes)."""
    n = len(data)
    raw = data + b"\0" * (G + 16)
    word = np.empty(n + G, np.uint64)
    for k in range(8):
        word[k::8] = np.frombuffer(raw, "<u8", len(word[k::8]), k)
    return _mixed([word[i : i + n] for i in (0, 8, 16)])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over [i, i + width) for each i; the tail is cut short at the end."""
    n, w = len(x), 1
    while w < min(width, n):
        step = min(w, width - w)
        new = np.empty_like(x)
        pick(x[: n - step], x[step:], out=new[: n - step])
        new[n - step :] = x[n - step :]
        x, w = new, w + step
    return x


def anchors(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The places of the smallest gram hash of each K bytes inside one text (all of equals);
    ``data`` holds texts of ``sizes`` one after the other."""
    whole = np.repeat(np.tile([True, False], len(sizes)), np.stack([np.maximum(sizes - K + 1, 0), np.minimum(sizes, K - 1)], 1).ravel())
    found, wide = [np.zeros(0, np.int64)], K - G
    for a in range(0, len(data), STEP):
        first, last = max(0, a - wide), min(len(data), a + STEP + wide)
        h = gram_hashes(data[first : last + G])[: last - first]
        rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never 0
        low = _sliding(rank, wide + 1, np.minimum) * whole[first:last]
        most = _sliding(low[::-1], wide + 1, np.maximum)[::-1]
        at = np.flatnonzero(most == rank) + first
        found.append(at[(at >= a) & (at < a + STEP)])
    return np.concatenate(found)


def _cut(_: int, rows: pa.Table) -> tuple[pa.Table, int]:
    """A block's row: its doc_ids, the sizes and bytes of its texts and their anchors; and how many
    anchors there are."""
    raw = [(t or "").encode() for t in rows.column("text").to_pylist()]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = b"".join(raw)
    places = np.diff(anchors(data, sizes), prepend=0).astype(np.uint32)
    made = {"ids": [rows.column("doc_id").to_pylist()], "sizes": [sizes.tobytes()], "texts": [squeezed(data)], "places": [squeezed(places.tobytes())]}
    return pa.table(made, pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())])), len(places)


class Block:
    """The bytes of a block's texts, their bounds, doc_ids and anchors."""

    def __init__(self, row: dict):
        row = {n: x[0].as_py() for n, x in row.items()}
        self.ids = row["ids"]
        self.docs = np.array([LAST if x is None else x for x in self.ids], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.data = np.frombuffer(unsqueezed(row["texts"]), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.anchors = np.cumsum(np.frombuffer(unsqueezed(row["places"]), np.uint32), dtype=np.int64)
        self.row = np.searchsorted(self.ends, self.anchors, "right")
        self.hashes = np.empty(len(self.anchors), np.uint64)
        for a in range(0, len(self.anchors), STEP // 4):
            grams = self.data[self.anchors[a : a + STEP // 4, None] + np.arange(G)].view("<u8")
            self.hashes[a : a + STEP // 4] = _mixed([grams[:, i] for i in range(3)])

    def contexts(self, chosen: np.ndarray) -> np.ndarray:
        """A row for each chosen anchor: the bytes around it (its gram from SIDE on), zero
        beyond the document, then how many bytes there are before the gram and in all."""
        places, rows = self.anchors[chosen], self.row[chosen]
        out = np.zeros((len(places), G + 2 * SIDE + 2), np.uint8)
        for a in range(0, len(places), STEP // 8):
            p, row = places[a : a + STEP // 8], rows[a : a + STEP // 8]
            left = np.minimum(SIDE, p - self.starts[row])
            right = np.minimum(SIDE, self.ends[row] - p - G)
            at = p[:, None] + np.arange(-SIDE, G + SIDE)
            ok = (at >= (p - left)[:, None]) & (at < (p + G + right)[:, None])
            part = out[a : a + STEP // 8]
            part[:, :-2] = np.where(ok, self.data[np.where(ok, at, 0)], 0)
            part[:, -2], part[:, -1] = left, left + G + right
        return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and which of these each row equals. Rows are
    grouped by a hash; were two different ones ever to share it, whole rows are sorted."""
    _, first, of = np.unique(_row_hashes(rows), return_index=True, return_inverse=True)
    if (rows[first[of]] != rows).any():
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return first, of


class Owners:
    """Keys dealt to the shards that own them: their order, and each shard's stretch of it."""

    def __init__(self, hashes: np.ndarray, parts: int):
        of = ((hashes >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(of, kind="stable")
        self.pids, starts = np.unique(of[self.order], return_index=True)
        self.bounds = dict(zip(self.pids.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(of)])))

    def of(self, pid: int) -> np.ndarray:
        a, b = self.bounds[pid]
        return self.order[a:b]

    def __iter__(self):
        return ((p, self.order[a:b]) for p, (a, b) in self.bounds.items())


def _pack(*arrays: np.ndarray) -> bytes:
    return squeezed(b"".join(a.tobytes() for a in arrays))


class _Seen:
    """A block's distinct anchor hashes, in the order in which it asks about them."""

    def __init__(self, row: dict, parts: int):
        self.block = Block(row)
        self.keys, self.of = np.unique(self.block.hashes, return_inverse=True)
        self.owners = Owners(self.keys, parts)

    def several(self) -> np.ndarray:
        """Whether a key is in documents of more than one doc_id here."""
        d = self.block.docs[self.block.row]
        first = np.zeros(len(self.keys), np.int64)
        first[self.of] = d
        out = np.zeros(len(self.keys), bool)
        out[self.of[first[self.of] != d]] = True
        return out

    def shared(self, answers: pa.Table) -> np.ndarray:
        out = np.zeros(len(self.keys), bool)
        for p, blob in zip(answers.column("pid").to_pylist(), answers.column("blob").to_pylist()):
            at = self.owners.of(p)
            out[at] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(at)).astype(bool)
        return out


class _Contexts:
    """A block's distinct contexts around shared anchors, in the order it asks about them."""

    def __init__(self, seen: _Seen, answers: pa.Table, parts: int):
        chosen = np.flatnonzero(seen.shared(answers)[seen.of])
        rows = seen.block.contexts(chosen)
        first, self.of = distinct_rows(rows)
        self.rows = rows[first]
        self.place = seen.block.anchors[chosen]
        self.doc = seen.block.docs[seen.block.row[chosen]]
        self.least = np.full(len(first), LAST)
        np.minimum.at(self.least, self.of, self.doc)
        self.owners = Owners(seen.block.hashes[chosen][first], parts)


_BLOBS = "block long, pid long, blob binary"


def _rows(block: int, made: dict[int, bytes]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(made), pa.int64()), "pid": pa.array(list(made), pa.int64()), "blob": pa.array(list(made.values()), pa.binary())})


def _ask_hashes(parts: int, read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for b in batches for n in b.column(0).to_pylist()):
            s = _Seen(read(number), parts)
            several = s.several()
            yield from _rows(number, {p: s.keys[at].tobytes() + np.packbits(several[at]).tobytes() for p, at in s.owners}).to_batches()

    return run


def _answer_hashes(key: tuple, table: pa.Table) -> pa.Table:
    keys, several = [], []
    for b in table.column("blob").to_pylist():
        n = len(b) * 8 // 65
        keys.append(np.frombuffer(b, np.uint64, n))
        several.append(np.unpackbits(np.frombuffer(b, np.uint8, -1, 8 * n), count=n))
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, minlength=len(u)) + np.bincount(at, np.concatenate(several), minlength=len(u))
    parts = np.split((n > 1)[at], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"block": table.column("block"), "pid": table.column("pid"), "blob": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


def _ask_contexts(parts: int, read):
    def run(key: tuple, answers: pa.Table) -> pa.Table:
        c = _Contexts(_Seen(read(key[0].as_py()), parts), answers, parts)
        return _rows(key[0].as_py(), {p: np.uint32(len(at)).tobytes() + _pack(c.rows[at], c.least[at]) for p, at in c.owners})

    return run


def least_of_starts(rows: np.ndarray, least: np.ndarray, spill: Spill | None = None) -> np.ndarray:
    """For each context and each start in it: the smallest doc_id of the contexts that have
    the same K bytes (LAST where no K bytes are), from the sorted suffixes of all contexts."""
    m, width = len(rows), G + 2 * SIDE
    left, size = rows[:, -2].astype(int), rows[:, -1].astype(int)
    chars = np.ones((m, width + 1), np.uint16)  # 0 ends the text, 1 a context
    chars[:, :-1] = rows[:, :-2].astype(np.uint16) + 2
    j = np.arange(width + 1)
    inside = (j >= (SIDE - left)[:, None]) & (j < (SIDE - left + size)[:, None])
    inside[:, -1] = True
    place = np.append(np.flatnonzero(inside), -1)  # of each character, in the padded contexts
    text = np.append(chars[inside], 0).astype(np.uint16)
    begins = (j[: SIDE + 1] >= (SIDE - left)[:, None]) & (j[: SIDE + 1] + K <= (SIDE - left + size)[:, None])
    run = np.full((m, SIDE + 1), -1, np.int64)
    before = -1
    for at, common in sorted_suffixes(text, K, spill):
        of = before + np.cumsum(common < K)
        before = int(of[-1])
        p = place[at]
        row, start = np.divmod(p, width + 1)
        ok = (p >= 0) & (start <= SIDE)
        ok[ok] = begins[row[ok], start[ok]]
        run[row[ok], start[ok]] = of[ok]
    seen, of = np.unique(run[begins], return_inverse=True)
    low = np.full(len(seen), LAST)
    np.minimum.at(low, of, np.repeat(least, begins.sum(1)))
    out = np.full((m, SIDE + 1), LAST)
    out[begins] = low[of]
    return out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes; equal rows have equal hashes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    x = np.zeros(len(rows), np.uint64)
    for w in padded.view(np.uint64).T:
        x = (x ^ w) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


#: Of the SIDE bytes that a string of K has beside the gram, so many at least on the left and so
#: many on the right: whatever the split, one of these pairs holds.
SPLITS = [(20, 0), (13, 7), (7, 14), (0, 20)]


def can_share(rows: np.ndarray) -> np.ndarray:
    """Whether a context may have K bytes in common with another: those hold the gram and SIDE
    bytes around it, and so one of ``SPLITS``."""
    out = np.zeros(len(rows), bool)
    for left, right in SPLITS:
        _, of, n = np.unique(_row_hashes(rows[:, SIDE - left : SIDE + G + right]), return_inverse=True, return_counts=True)
        out |= n[of] > 1
    return out


def _answer_contexts(scratch: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        width = G + 2 * SIDE + 2
        rows, least = [], []
        for b in table.column("blob").to_pylist():
            n, raw = int(np.frombuffer(b, np.uint32, 1)[0]), unsqueezed(b[4:])
            rows.append(np.frombuffer(raw, np.uint8, n * width).reshape(n, width))
            least.append(np.frombuffer(raw, np.int64, n, n * width))
        sizes = np.cumsum([len(x) for x in least])[:-1]
        every = np.concatenate(rows)
        first, at = distinct_rows(every)
        distinct = every[first]
        low = np.full(len(first), LAST)
        np.minimum.at(low, at, np.concatenate(least))
        mixed = can_share(distinct)
        where = np.cumsum(mixed) - 1
        starts = least_of_starts(distinct[mixed], low[mixed], Spill(QUEUE_BYTES, scratch, NAME_BYTES))
        blobs = []
        for i in np.split(at, sizes):
            m = mixed[i]
            blobs.append(_pack(low[i], m, starts[where[i[m]]]))
        return pa.table({"block": table.column("block"), "pid": table.column("pid"), "blob": pa.array(blobs, pa.binary())})

    return run


def _remove(parts: int, read):
    def run(key: tuple, answers: pa.Table) -> pa.Table:
        seen = _Seen(read(key[0].as_py()), parts)
        kind = answers.column("kind").to_pylist()
        c = _Contexts(seen, answers.filter(pa.array([k == 1 for k in kind], pa.bool_())), parts)
        told = answers.filter(pa.array([k == 2 for k in kind], pa.bool_()))
        left, size = c.rows[:, -2].astype(int), c.rows[:, -1].astype(int)
        j = np.arange(SIDE + 1)
        inside = (j >= (SIDE - left)[:, None]) & (j + K <= (SIDE - left + size)[:, None])
        least = np.full((len(c.rows), SIDE + 1), LAST)
        for p, blob in zip(told.column("pid").to_pylist(), told.column("blob").to_pylist()):
            at, raw = c.owners.of(p), unsqueezed(blob)
            least[at] = np.frombuffer(raw, np.int64, len(at))[:, None]
            m = np.frombuffer(raw, np.uint8, len(at), 8 * len(at)).astype(bool)
            least[at[m]] = np.frombuffer(raw[9 * len(at) :], np.int64).reshape(-1, SIDE + 1)
        low = np.where(inside, least, LAST).min(1, initial=LAST)
        late, begins = np.flatnonzero(low[c.of] < c.doc), [np.zeros(0, np.int64)]
        for a in range(0, len(late), STEP // 4):
            s = late[a : a + STEP // 4]
            hit = inside[c.of[s]] & (least[c.of[s]] < c.doc[s, None])
            begins.append((c.place[s, None] - SIDE + j)[hit])
        begins = np.unique(np.concatenate(begins))
        b = seen.block
        row = np.searchsorted(b.ends, begins, "right")
        new = np.flatnonzero((np.diff(begins, prepend=-K - 1) > K) | (np.diff(row, prepend=-1) > 0))
        first, last = begins[new], begins[np.append(new, len(begins))[1:] - 1] + K
        of, n = row[new], len(b.docs)
        removed = np.bincount(of, last - first, minlength=n).astype(np.int64)
        spans = np.bincount(of, minlength=n)
        shas, k = [], 0
        for i, (x, y) in enumerate(zip(b.starts.tolist(), b.ends.tolist())):
            sha = hashlib.sha256()
            for _ in range(spans[i]):
                sha.update(b.data[x : first[k]])
                x, k = last[k], k + 1
            sha.update(b.data[x:y])
            shas.append(sha.hexdigest())
        return _result(b.ids, b.sizes, removed, spans, shas)

    return run


def _result(ids, sizes, removed, spans, shas) -> pa.Table:
    longs = lambda x: pa.array(x, pa.int64())
    return pa.table({"doc_id": longs(ids), "n_bytes": longs(sizes), "n_removed": longs(removed), "n_spans": longs(spans), "kept_sha256": pa.array(shas, pa.string())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    cut = BlockFiles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BLOCK_BYTES, "text", _cut)
    parts, read = int(max(12, -(-cut.size // SHARD_ANCHORS))), cut.reader()
    shared = stored(cut.numbers().mapInArrow(_ask_hashes(parts, read), _BLOBS).groupBy("pid").applyInArrow(_answer_hashes, _BLOBS))
    scratch = f"{shared_dir(spark)}/plumbline-scratch-{uuid.uuid4().hex}"
    try:
        least = stored(cut.dealt(shared).groupBy("block").applyInArrow(_ask_contexts(parts, read), _BLOBS).groupBy("pid").applyInArrow(_answer_contexts(scratch), _BLOBS))
    finally:
        drop_folder(spark, scratch)
    every = cut.told.select("block", F.lit(-1).cast("long").alias("pid"), F.lit(None).cast("binary").alias("blob"), F.lit(0).alias("kind"))  # also blocks without anchors
    told = shared.withColumn("kind", F.lit(1)).unionByName(least.withColumn("kind", F.lit(2))).unionByName(every)
    return cut.dealt(told).groupBy("block").applyInArrow(_remove(parts, read), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
