"""External suffix sorting by induction, with common-prefix values.

Suffix tuples (place, the characters before it, common prefix with the tuple before) go
through priority queues ordered by first character and arrival; their blocks lie on disk
beyond ``limit`` bytes. Larger suffixes (L) are induced in ascending order from the sorted
left-most smaller suffixes (S*), smaller ones (S) in descending order from the L ones. One
induction sorts the S* substrings; equal ones share a name, and the text of names is sorted
by recursion, or in memory once it fits ``limit``. A second induction, seeded with the sorted
S*, yields every suffix; the common prefix of two induced suffixes is one more than the
smallest value met between their inducers.

What exceeds memory lies in a folder that the cluster shares (``Spill``). The files belong to
one call; a lost executor loses only a task that runs again, and the caller deletes the folder.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyarrow import fs

LIMIT = 256_000_000
BLOCK = 1 << 20
TUPLE = np.dtype([("at", "<i8"), ("word", "<u8"), ("lcp", "u1")])


class Spill:
    """How many bytes each array and queue of a sort may hold in memory, how many the names of
    substrings may take to be sorted there, and the folder that takes the rest (none: memory does). Queues go to any file system that pyarrow opens;
    arrays, which are read and written in any order, only to a mounted one."""

    def __init__(self, limit: int = LIMIT, uri: str | None = None, names: int | None = None):
        self.limit, self.uri, self.names = limit, uri, limit if names is None else names
        self.files, self.path, self.mounted = None, "", False
        if uri:
            self.files, self.path = fs.FileSystem.from_uri(uri)
            self.mounted = isinstance(self.files, fs.LocalFileSystem)
            self.files.create_dir(self.path, recursive=True)

    def smaller(self, by: int) -> Spill:
        return Spill(self.limit // by, self.uri, self.names)

    def file(self):
        """A file without a name that vanishes when it is closed."""
        return tempfile.TemporaryFile(dir=self.path)


class Text:
    """Characters read as aligned 64-bit words; the last one is 0 and occurs once."""

    def __init__(self, chars: np.ndarray, spill: Spill):
        self.n, self.bits = len(chars), chars.dtype.itemsize * 8
        self.per = 64 // self.bits
        padded = np.zeros(-(-self.n // self.per) * self.per, chars.dtype)
        padded[: self.n] = chars
        self.chars = scratch(padded, spill) if spill.mounted and padded.nbytes > spill.limit else padded
        self.words = self.chars.view(np.uint64)

    def word_before(self, at: np.ndarray) -> np.ndarray:
        """The word that holds the character before each place, fetched in text order."""
        i = np.maximum(at - 1, 0) // self.per
        if not isinstance(self.words, np.memmap):
            return self.words[i]
        order = np.argsort(i)
        out = np.empty(len(i), np.uint64)
        out[order] = self.words[i[order]]
        return out

    def before(self, t: np.ndarray) -> np.ndarray:
        """The character before each tuple's place, from the word it carries."""
        shift = ((t["at"] - 1) % self.per * self.bits).astype(np.uint64)
        return (t["word"] >> shift & np.uint64(2**self.bits - 1)).astype(np.int64)

    def common(self, p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
        """Equal characters from places p and q on, at most cap."""
        out, live = np.zeros(len(p), np.int64), np.arange(len(p))
        for k in range(cap):
            a, b = p[live] + k, q[live] + k
            inside = np.maximum(a, b) < self.n
            live, a, b = live[inside], a[inside], b[inside]
            live = live[self.chars[a] == self.chars[b]]
            if not len(live):
                break
            out[live] += 1
        return out

    def leftmost_smaller(self, spill: Spill) -> np.ndarray:
        """The places of S* suffixes in text order (the end included), found block by block
        from the right."""
        found, smaller, after = [], True, None
        for b in range(self.n, 0, -BLOCK):
            a = max(0, b - BLOCK)
            c = self.chars[a:b].astype(np.int64)
            following = np.append(c[1:], -1 if after is None else after[0])
            rises = np.sign(following - c)  # 1: S, -1: L, 0: as the next one
            if after is None:
                rises[-1] = 1
            where = np.where(rises != 0, np.arange(len(c)), len(c))
            where = np.minimum.accumulate(where[::-1])[::-1]
            s = np.append(rises > 0, smaller)[where]
            next_s = np.append(s[1:], smaller)
            if after is None:
                next_s[-1] = False
            star = np.flatnonzero(~s & next_s) + a + 1
            found.append(gathered([star[star < self.n]], np.int64, spill.smaller(64)))
            smaller, after = bool(s[0]), c
        return gathered(found[::-1], np.int64, spill) if self.n > 1 else np.zeros(1, np.int64)


def scratch(a: np.ndarray, spill: Spill) -> np.ndarray:
    with spill.file() as f:
        a.tofile(f)
        f.flush()
        return np.memmap(f, a.dtype, "r+", shape=a.shape)


def gathered(parts: Iterable[np.ndarray], dtype, spill: Spill) -> np.ndarray:
    """The parts one after the other; in a file beyond the limit."""
    held, size, file = [], 0, None
    for p in parts:
        p = np.asarray(p, dtype)
        size += p.nbytes
        held.append(p)
        if spill.mounted and size > spill.limit and file is None:
            file = spill.file()
        if file is not None:
            for h in held:
                h.tofile(file)
            held = []
    if file is None:
        return np.concatenate(held) if held else np.zeros(0, dtype)
    file.flush()
    with file:
        return np.memmap(file, dtype, "r+", shape=(size // np.dtype(dtype).itemsize,))


def cut(n: int) -> Iterator[slice]:
    return (slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK))


class Queue:
    """A disk-backed priority queue of tuple blocks: by character, then by arrival. Blocks
    stay readable after they were taken."""

    def __init__(self, spill: Spill, sign: int = 1):
        self.blocks: dict[int, list] = {}
        self.heap: list[int] = []
        self.held, self.spill, self.sign = 0, spill, sign
        self.names: list[str] = []
        self.opened: dict[str, object] = {}

    def push(self, key: int, block: np.ndarray) -> None:
        if key not in self.blocks:
            self.blocks[key] = []
            heapq.heappush(self.heap, self.sign * key)
            block["lcp"][0] = 0
        self.blocks[key].append(block)
        self.held += block.nbytes
        if self.spill.files and self.held > self.spill.limit:
            self._write()

    def _write(self) -> None:
        """All blocks held, as one new file."""
        name, at = f"{self.spill.path}/{uuid.uuid4().hex}", 0
        self.names.append(name)
        with self.spill.files.open_output_stream(name) as out:
            for blocks in self.blocks.values():
                for i, b in enumerate(blocks):
                    if isinstance(b, np.ndarray):
                        out.write(b.tobytes())
                        blocks[i] = (name, at, b.nbytes)
                        at += b.nbytes
        self.held = 0

    def _read(self, b) -> np.ndarray:
        if isinstance(b, np.ndarray):
            return b
        name, at, size = b
        if name not in self.opened:
            self.opened[name] = self.spill.files.open_input_file(name)
        return np.frombuffer(self.opened[name].read_at(size, at), TUPLE)

    def close(self) -> None:
        for f in self.opened.values():
            f.close()
        for name in self.names:
            self.spill.files.delete_file(name)

    def take(self, key: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """The blocks of a key, those pushed meanwhile included; small ones are joined."""
        blocks = self.blocks.get(key, [])
        if backwards:
            part: list[np.ndarray] = []
            n = 0
            for i in range(len(blocks) - 1, -1, -1):
                part.append(self._read(blocks[i]))
                n += len(part[-1])
                if i == 0 or n >= BLOCK:
                    yield np.concatenate(part[::-1])
                    part, n = [], 0
            return
        i = 0
        while i < len(blocks):
            j, n, part = i, 0, []
            while j < len(blocks) and n < BLOCK:
                part.append(self._read(blocks[j]))
                n, j = n + len(part[-1]), j + 1
            i = j
            yield part[0] if len(part) == 1 else np.concatenate(part)


def backwards(blocks: Iterator[np.ndarray], first: int) -> Iterator[np.ndarray]:
    """Blocks from a reverse iteration, each turned round; common prefixes then refer to the
    tuple that now comes before, ``first`` to the one before all."""
    for b in blocks:
        r = b[::-1].copy()
        r["lcp"][1:] = b["lcp"][:0:-1]
        r["lcp"][0], first = first, b["lcp"][0]
        yield r


class Smallest:
    """Minima over ranges of a block's common prefixes."""

    def __init__(self, x: np.ndarray):
        self.rows, w = [x], 1
        while 2 * w <= len(x):
            self.rows.append(np.minimum(self.rows[-1][:-w], self.rows[-1][w:]))
            w *= 2

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, both included; 255 where there are none."""
        out = np.full(len(a), 255, np.uint8)
        size = b - a + 1
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]):
            m = (level == k) & (size > 0)
            row = self.rows[k]
            out[m] = np.minimum(row[a[m]], row[b[m] + 1 - (1 << k)])
        return out


class Induction:
    """One direction: tuples come in order, those before them are pushed."""

    def __init__(self, text: Text, queue: Queue, sigma: int, cap: int):
        self.text, self.queue, self.cap = text, queue, cap
        self.low = np.full(sigma if cap else 0, 255, np.uint8)

    def feed(self, t: np.ndarray, wanted) -> None:
        c = self.text.before(t)
        sel = np.flatnonzero((t["at"] > 0) & wanted(c))
        if self.cap:
            least = Smallest(t["lcp"])
            whole = t["lcp"].min()
        if len(sel):
            key = c[sel]
            order = np.argsort(key.astype(np.uint16) if self.text.bits == 16 else key, kind="stable")
            sel, key = sel[order], key[order]
            new = np.empty(len(sel), TUPLE)
            new["at"] = t["at"][sel] - 1
            new["word"] = t["word"][sel]
            turn = np.flatnonzero(new["at"] % self.text.per == 0)
            new["word"][turn] = self.text.word_before(new["at"][turn])
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(cuts[1:], len(key))
            new["lcp"] = 0
            if self.cap:
                a = np.append(0, sel[:-1] + 1)
                a[cuts] = 0
                low = least.over(a, sel)
                low[cuts] = np.minimum(low[cuts], self.low[key[cuts]])
                new["lcp"] = np.minimum(low.astype(np.int64) + 1, self.cap)
        if self.cap:
            self.low = np.minimum(self.low, whole)
        if len(sel):
            if self.cap:
                last = sel[ends - 1]
                self.low[key[cuts]] = least.over(last + 1, np.full(len(last), len(t) - 1))
            for k, a, b in zip(key[cuts].tolist(), cuts.tolist(), ends.tolist()):
                self.queue.push(k, new[a:b])


def _tuples(text: Text, at: np.ndarray, lcp) -> np.ndarray:
    out = np.empty(len(at), TUPLE)
    out["at"], out["word"], out["lcp"] = at, text.word_before(at), lcp
    return out


def induce(text: Text, seeds: Iterator[np.ndarray], sigma: int, cap: int, spill: Spill) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(character, whether of type S, tuples) in suffix order, from S* suffixes in order."""
    queues = Queue(spill), Queue(spill), Queue(spill, -1)
    try:
        yield from _induce(text, seeds, sigma, cap, *queues)
    finally:
        for q in queues:
            q.close()


def _induce(text: Text, seeds: Iterator[np.ndarray], sigma: int, cap: int, star: Queue, larger: Queue, smaller: Queue) -> Iterator[tuple[int, bool, np.ndarray]]:
    for t in seeds:
        c = text.chars[t["at"]]
        cuts = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
        for a, b in zip(cuts[:-1], cuts[1:]):
            star.push(int(c[a]), t[a:b])

    def seam(p: int, q: int) -> int:
        return int(text.common(np.array([p]), np.array([q]), cap)[0]) if cap else 0

    last: dict[int, int] = {}
    step = Induction(text, larger, sigma, cap)
    while larger.heap or star.heap:
        key = min(q.heap[0] for q in (larger, star) if q.heap)
        for t in larger.take(key):
            step.feed(t, lambda c: c >= key)
            last[key] = int(t["at"][-1])
        first = True
        for t in star.take(key):
            if first and key in last:
                t = t.copy()
                t["lcp"][0] = seam(last[key], int(t["at"][0]))
            first = False
            step.feed(t, lambda c: c >= key)
        for q in (larger, star):
            if q.heap and q.heap[0] == key:
                heapq.heappop(q.heap)

    least: dict[int, int] = {}
    step = Induction(text, smaller, sigma, cap)
    keys = sorted(last)
    while keys or smaller.heap:
        key = max([*keys[-1:], *(-k for k in smaller.heap[:1])])
        for t in smaller.take(key):
            step.feed(t, lambda c: c <= key)
            least[key] = int(t["at"][-1])
        if keys and keys[-1] == key:
            keys.pop()
            at = seam(last[key], least[key]) if key in least else 0
            for t in backwards(larger.take(key, backwards=True), at):
                step.feed(t, lambda c: c < key)
        if smaller.heap and smaller.heap[0] == -key:
            heapq.heappop(smaller.heap)

    yield 0, True, _tuples(text, np.array([text.n - 1]), 0)
    for key in sorted({*last, *least}):
        for t in larger.take(key):
            yield key, False, t
        if key in least:
            at = seam(last[key], least[key]) if key in last else 0
            for t in backwards(smaller.take(key, backwards=True), at):
                yield key, True, t


def _in_memory(names: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; for texts of names that fit the limit."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        key = rank * (n + 1)
        key[: max(n - k, 0)] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        if new[-1] == n - 1:
            return order
        rank[order] = new
        k *= 2


def _by_character(text: Text, star: np.ndarray) -> Iterator[np.ndarray]:
    for s in cut(len(star)):
        at = np.array(star[s])
        yield _tuples(text, at[np.argsort(text.chars[at], kind="stable")], 0)


def _starred(text: Text, sigma: int, spill: Spill) -> np.ndarray:
    """The S* places in suffix order."""
    star = text.leftmost_smaller(spill)
    n = len(star)

    def sorted_substrings() -> Iterator[np.ndarray]:
        for key, small, t in induce(text, _by_character(text, star), sigma, 0, spill):
            if small:
                yield t["at"][(t["at"] == text.n - 1) | ((text.before(t) > key) & (t["at"] > 0))]

    ordered = gathered(sorted_substrings(), np.int64, spill)
    reduced = gathered((np.zeros(s.stop - s.start, np.uint32) for s in cut(n)), np.uint32, spill)
    name, before, size_before = -1, None, 0
    for s in cut(n):
        at = np.array(ordered[s])
        index = np.searchsorted(star, at)
        size = star[np.minimum(index + 1, n - 1)] - at  # 0: the end, alone of its kind
        p = np.append(at[:1] if before is None else before, at[:-1])
        same = size == np.append(size_before, size[:-1])
        pair = np.flatnonzero(same)
        if len(pair):
            same[pair] = text.common(p[pair], at[pair], int(size[pair].max()) + 1) > size[pair]
        if before is None:
            same[0] = False
        names = name + np.cumsum(~same)
        reduced[index] = names
        name, before, size_before = int(names[-1]), at[-1:], size[-1]
    if name == n - 1:
        return ordered
    if reduced.nbytes * 8 <= spill.names:
        return star[_in_memory(reduced)]
    order = _order(reduced, spill)
    return gathered((star[order[s]] for s in cut(n)), np.int64, spill)


def _order(names: np.ndarray, spill: Spill) -> np.ndarray:
    text, sigma = Text(names, spill), int(names.max()) + 1
    star = _starred(text, sigma, spill)
    seeds = (_tuples(text, star[s], 0) for s in cut(len(star)))
    return gathered((t["at"] for _, _, t in induce(text, seeds, sigma, 0, spill)), np.int64, spill)


def sorted_suffixes(chars: np.ndarray, cap: int, spill: Spill | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefix with the suffix before, at most ``cap`` < 255) in suffix order,
    block by block. ``chars``: uint16, ending in its only 0."""
    spill = spill or Spill()
    text, sigma = Text(chars, spill), int(chars.max()) + 1
    star = _starred(text, sigma, spill)

    def seeds() -> Iterator[np.ndarray]:
        before = star[:1]
        for s in cut(len(star)):
            at = np.array(star[s])
            yield _tuples(text, at, text.common(np.append(before, at[:-1]), at, cap))
            before = at[-1:]

    for _, _, t in induce(text, seeds(), sigma, cap, spill):
        yield t["at"], t["lcp"]
