"""Operator 10: language-model scoring by a weighted backoff automaton.

Words and an end token; a trigram model, each order smoothed by the one below:

``P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))``,
``P(w | v) = (c(v, w) + MU[0] P(w)) / (c(v) + MU[0])``,
``P(w | u, v) = (c(u, v, w) + MU[1] P(w | v)) / (c(u, v) + MU[1])``, or ``P(w | v)`` if (u, v) is new.

As an automaton: a state for each history that training has seen (of two words, of one, and the
empty one), an arc with its log probability for each word seen after it, which leads to the
longest history that the arc ends in, and a failure arc of weight ``MU / (c + MU)`` to the
state of the history without its first word. The empty history has an arc for every word.
``Automaton.traverse`` goes from left to right: at each token it follows failure arcs until
the state has an arc for the token, adds up the weights, and carries on in the arc's target.

The corpus counts are distributed and complete. Rows are cut into blocks, whose word numbers are
written once to the shared folder, where later steps read them. First a block sends each distinct
word once, with its count in training rows, to the partition that owns the word, which sums them
and answers with the sum and a number that the word has in all blocks. Then it sends each distinct
bigram and trigram in these numbers to the partition that owns the bigram (a trigram goes with its
first two words), which sums and answers in the block's own order. So a word in every document is
one entry a block, the automaton of no more than a block is in one task, and nothing is broadcast
but a few totals.

Words are told apart by a 64-bit hash. N-grams are told apart exactly: a bigram's key is a bijection
of its words' two numbers, a trigram is its bigram and the third word's number (with more than 2^32
different words keys are 64 bits of a mix of the numbers). Counts are of 64 bits.

Defined cases: a null text counts as empty and scores its end token alone; repeated rows are
learned from and scored one by one; without training rows N and V are 0; a null doc_id hashes
as the empty string; other columns are kept by ``score``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import BlockFiles, packed, squeezed, stored, unpacked, unsqueezed

MU = (40.0, 10.0)
BLOCK_BYTES = 4_000_000
OWNER_TOKENS = 1_000_000  # whose n-grams one partition owns
LEAST_BITS = 16  # of a word's number in a key
LANE = 256  # tokens that a lane of the traversal goes through
_START, _END = b"  ", b" "  # no word holds a space


def word_hash(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 1) for w in words), np.uint64)


def spread(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Keys of 2 ``bits`` (64 at most) for pairs of numbers of ``bits``: different pairs have different
    keys, which are spread evenly, as each step can be undone."""
    if 2 * bits > 64:
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
    shift, mask = np.uint64(bits), np.uint64((1 << 2 * bits) - 1)
    x = a << shift | b
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = ((x ^ (x >> shift)) * np.uint64(odd)) & mask
    return x ^ (x >> shift)


def numbered(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words by number: the start is 0, the end 1; tokens as word numbers, each text's end
    included; tokens of each text)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    start, end = number[_START], number[_END]
    seqs = []
    for t in texts:
        w = (t or "").encode().lower().split()  # bytes: A-Z only, ASCII spaces only
        seqs.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    tokens = np.concatenate([np.zeros(0, np.int32), *[x for s in seqs for x in (s, np.int32([end]))]])
    return list(number), tokens, np.array([len(s) + 1 for s in seqs], np.int64)


class Block:
    """The texts of a block as word numbers; with ``grams`` its distinct n-grams: ``bigrams`` (keys, in
    order) and their words, trigrams in order of their bigram and their words."""

    start = 0

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.hash, self.tokens, self.sizes = hashes, tokens, sizes
        self.last = np.cumsum(sizes)
        self.first = np.zeros(len(tokens), bool)
        self.first[self.last - sizes] = True
        self.before = np.where(self.first, np.int32(self.start), np.append(np.int32([self.start]), tokens[:-1])[: len(tokens)])

    def grams(self, ids: np.ndarray, bits: int) -> Block:
        """Finds the n-grams; ``ids`` are the numbers that the block's words have in all blocks."""
        wide = lambda x: x.astype(np.uint64)
        _, at, pair = np.unique(wide(self.before) << np.uint64(32) | wide(self.tokens), return_index=True, return_inverse=True)
        keys = spread(ids[self.before[at]], ids[self.tokens[at]], bits)
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.bigrams, self.arc, at = keys[order], rank[pair], at[order]
        self.bigram_of = self.before[at], self.tokens[at]
        self.inner = np.flatnonzero(~self.first)  # tokens with two words before, the start included
        _, at, self.third = np.unique(wide(self.arc[self.inner - 1]) << np.uint64(32) | wide(self.tokens[self.inner]), return_index=True, return_inverse=True)
        self.trigram_of = self.arc[self.inner[at] - 1], self.tokens[self.inner[at]], self.arc[self.inner[at]]
        self.trigrams = ids[self.trigram_of[1]]
        return self

    def per_row(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.last - self.sizes) if len(self.last) else np.zeros(0)

    def words(self, train: np.ndarray) -> np.ndarray:
        found = np.bincount(self.tokens[np.repeat(train, self.sizes)], minlength=len(self.hash))
        found[self.start] = train.sum()
        return found

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.repeat(train, self.sizes)
        return np.bincount(self.arc[ok], minlength=len(self.bigrams)), np.bincount(self.third[ok[self.inner]], minlength=len(self.trigrams))


def _owners(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The partition that owns each key, by its upper bits, so that a partition's keys lie close together."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _stretches(pids: np.ndarray, *owners: np.ndarray) -> Iterator[tuple]:
    """(partition, its stretch of each of the lists, which are in order of their owners)."""
    bounds = [np.stack([np.searchsorted(x, pids, side) for side in ("left", "right")], 1).tolist() for x in owners]
    for p, *ends in zip(pids.tolist(), *bounds):
        yield p, *[slice(*e) for e in ends]


def dealt_words(b: Block, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, the words that it owns)."""
    order = np.argsort(b.hash)
    owner = _owners(b.hash[order], 64, parts)
    for p, w in _stretches(np.unique(owner), owner):
        yield p, order[w]


def dealt_grams(b: Block, bits: int, parts: int) -> Iterator[tuple[int, slice, slice]]:
    """(partition, its stretch of bigrams, its stretch of trigrams)."""
    a = _owners(b.bigrams, min(2 * bits, 64), parts)
    yield from _stretches(np.unique(a), a, a[b.trigram_of[0]])


def _planes(x: np.ndarray) -> bytes:
    """Integers as bytes of equal weight side by side, which packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([[len(a), a.dtype.itemsize] for a in arrays], np.int64)
    return squeezed(sizes.tobytes() + b"".join(map(_planes, arrays)))


def _unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw, out = unsqueezed(blob), []
    at = 16 * len(dtypes)
    for (n, size), dtype in zip(np.frombuffer(raw, np.int64, 2 * len(dtypes)).reshape(-1, 2).tolist(), dtypes):
        out.append(_unplanes(raw[at : at + n * size], dtype))
        at += n * size
    return out


def _cut(keep: list[str]):
    def make(_: int, rows: pa.Table) -> tuple[pa.Table, int]:
        words, tokens, sizes = numbered(rows.column("text").to_pylist())
        made = {
            "words": pa.array([squeezed(b" ".join(words[2:]))], pa.binary()),
            "texts": pa.array([_pack(tokens, sizes)], pa.binary()),
            "train": pa.array([rows.column("train").to_pylist()], pa.list_(pa.bool_())),
        }
        if keep:
            held = pa.StructArray.from_arrays([pa.concat_arrays(rows.column(c).chunks) for c in keep], names=keep)
            made["keep"] = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return pa.table(made), len(tokens)

    return make


def _block(row: dict) -> Block:
    known = unsqueezed(row["words"][0].as_py())
    return Block(word_hash([_START, _END, *(known.split(b" ") if known else [])]), *_unpack(row["texts"][0].as_py(), np.int32, np.int64))


_BLOBS = "block long, pid long, blob binary, n long, v long, top long"


def _rows(block, pid, blob, n=None, v=None, top=None) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    none = [0] * len(pid)
    return pa.table([pa.array(x, k) for x, k in zip((block, pid, blob, n or none, v or none, top or none), kinds)], names=["block", "pid", "blob", "n", "v", "top"])


def _near(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _ask_words(parts: int, read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            row = read(number)
            b = _block(row)
            words, pids, blobs = b.words(np.array(row["train"][0].as_py(), bool)), [], []
            for p, w in dealt_words(b, parts):
                pids.append(p)
                blobs.append(_pack(_near(b.hash[w]), words[w]))
            yield from _rows([number] * len(pids), pids, blobs).to_batches()

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each list's totals in its own order; the distinct keys, which each is, and their totals."""
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return np.split(total[at], np.cumsum([len(k) for k in keys])[:-1]), u, at, total


def _answer_words(parts: int):
    """Sums, and numbers: a word's place among the partition's and the partition's number make one
    that no other word has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        asked = [_unpack(x.as_py(), np.uint64, np.int64) for x in table.column("blob")]
        words, u, at, total = _summed([np.cumsum(x[0], dtype=np.uint64) for x in asked], [x[1] for x in asked])
        ids = np.split(at, np.cumsum([len(x) for x in words])[:-1])
        real = u != word_hash([_START])[0]
        n, v, top = [0] * len(asked), [0] * len(asked), [len(u) * parts + p] * len(asked)
        n[0], v[0] = int(total[real].sum()), int((total[real] > 0).sum())
        return _rows(table.column("block").to_pylist(), [p] * len(asked), [_pack(c, i.astype(np.int64)) for c, i in zip(words, ids)], n, v, top)

    return run


def _known(b: Block, parts: int, said: dict) -> tuple[np.ndarray, np.ndarray]:
    """(count, number) of each of a block's words from the answers by partition."""
    words, ids = np.zeros(len(b.hash), np.int64), np.zeros(len(b.hash), np.uint64)
    for p, w in dealt_words(b, parts):
        words[w], place = _unpack(said[p].as_py(), np.int64, np.int64)
        ids[w] = place.astype(np.uint64) * np.uint64(parts) + np.uint64(p)
    return words, ids


def _ask_grams(parts: int, bits: int, read):
    def run(key: tuple, answers: pa.Table) -> pa.Table:
        row = read(key[0].as_py())
        b = _block(row)
        _, ids = _known(b, parts, dict(zip(answers.column("pid").to_pylist(), answers.column("blob"))))
        arcs, thirds = b.grams(ids, bits).counts(np.array(row["train"][0].as_py(), bool))
        pids, blobs = [], []
        for p, a, t in dealt_grams(b, bits, parts):
            follow = np.bincount(b.trigram_of[0][t] - a.start, minlength=a.stop - a.start).astype(np.uint32)
            pids.append(p)
            blobs.append(_pack(_near(b.bigrams[a]), arcs[a], follow, b.trigrams[t], thirds[t]))
        return _rows([key[0].as_py()] * len(pids), pids, blobs)

    return run


def _answer_grams(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        u64, shift = np.uint64, np.uint64(max(bits, 32))
        asked = [_unpack(x.as_py(), u64, np.int64, np.uint32, u64, np.int64) for x in table.column("blob")]
        arcs, _, at, _ = _summed([np.cumsum(x[0], dtype=u64) for x in asked], [x[1] for x in asked])
        first = np.split(at, np.cumsum([len(x[0]) for x in asked])[:-1])
        thirds, _, _, _ = _summed([np.repeat(f, x[2]).astype(u64) << shift | x[3] for f, x in zip(first, asked)], [x[4] for x in asked])
        return _rows(table.column("block").to_pylist(), table.column("pid").to_pylist(), [_pack(*x) for x in zip(arcs, thirds)])

    return run


class Automaton:
    """Over one block's n-grams. State 0 is the empty history, 1 + v the history of word v,
    then come those of two words. ``keys`` lists the arcs of all states but 0 as state and
    word; ``weight`` and ``target`` are theirs, ``fail`` and ``falls`` the failure arcs."""

    def __init__(self, b: Block, words: np.ndarray, arcs: np.ndarray, thirds: np.ndarray, n: int, v: int, mu: tuple = MU):
        unigram = words.astype(float)
        unigram[b.start] = 0
        self.base = np.log10((unigram + 0.1) / (n + 0.1 * (v + 1)))
        history, word = b.bigram_of
        pair = (arcs + mu[0] * 10.0 ** self.base[word]) / (words[history] + mu[0])
        before, third, after = b.trigram_of
        seen = arcs > 0
        state = np.where(seen, 1 + len(words) + np.arange(len(arcs)), 0)  # of each bigram
        self.one = np.where(words > 0, 1 + np.arange(len(words)), 0)  # of each word
        self.begin = self.one[b.start]
        two, three = np.flatnonzero(seen), np.flatnonzero(thirds > 0)
        keys = np.concatenate(((1 + history[two].astype(np.int64)) << 32 | word[two], state[before[three]] << 32 | third[three]))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate((pair[two], (thirds[three] + mu[1] * pair[after[three]]) / (arcs[before[three]] + mu[1]))))[order]
        self.target = np.concatenate((state[two], state[after[three]]))[order]
        self.fail = np.log10(np.concatenate(([1.0], mu[0] / (words + mu[0]), mu[1] / (arcs + mu[1]))))
        self.falls = np.concatenate(([0], np.zeros(len(words), np.int64), self.one[word]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 weight, next state) of each lane's token."""
        weight, out = np.zeros(len(word)), np.zeros(len(word), np.int64)
        live, at = np.arange(len(word)), state
        while len(live):
            key = at << 32 | word[live]
            i = np.searchsorted(self.keys, key)
            hit = (i < len(self.keys)) & (at > 0)
            hit[hit] = self.keys[i[hit]] == key[hit]
            weight[live[hit]] += self.weight[i[hit]]
            out[live[hit]] = self.target[i[hit]]
            empty = at == 0
            weight[live[empty]] += self.base[word[live[empty]]]
            out[live[empty]] = self.one[word[live[empty]]]
            down = ~hit & ~empty
            weight[live[down]] += self.fail[at[down]]
            live, at = live[down], self.falls[at[down]]
        return weight, out

    def traverse(self, b: Block) -> np.ndarray:
        """Each token's log10 probability. The tokens are cut into lanes that advance together;
        a lane starts two tokens early from the empty history, after which its state is the one
        that a single pass would carry, since no history is longer."""
        n = len(b.tokens)
        out = np.zeros(n)
        starts = np.arange(0, n, LANE)
        state = np.zeros(len(starts), np.int64)
        for k in range(-2, LANE):
            at = starts + k
            ok = (at >= 0) & (at < n)
            lane = np.flatnonzero(ok)
            at = at[lane]
            weight, state[lane] = self.step(np.where(b.first[at], self.begin, state[lane]), b.tokens[at].astype(np.int64))
            if k >= 0:
                out[at] = weight
        return out


def _score(parts: int, bits: int, n: int, v: int, read, schema: pa.Schema):
    def run(key: tuple, answers: pa.Table) -> pa.Table:
        row = read(key[0].as_py())
        b = _block(row)
        said: tuple[dict, dict] = {}, {}
        for kind, p, blob in zip(answers.column("kind").to_pylist(), answers.column("pid").to_pylist(), answers.column("blob")):
            said[kind][p] = blob
        words, ids = _known(b, parts, said[0])
        b.grams(ids, bits)
        arcs, thirds = np.zeros(len(b.bigrams), np.int64), np.zeros(len(b.trigrams), np.int64)
        for p, a, t in dealt_grams(b, bits, parts):
            arcs[a], thirds[t] = _unpack(said[1][p].as_py(), np.int64, np.int64)
        auto = Automaton(b, words, arcs, thirds, n, v)
        known = (words > 0)[b.tokens]
        made = [b.sizes, b.per_row(known.astype(np.int64)), np.full(len(b.sizes), n), b.per_row(auto.base[b.tokens]), b.per_row(auto.traverse(b))]
        held = row["keep"].flatten().flatten() if "keep" in row else []
        return pa.table(dict(zip(schema.names, [*held, *map(pa.array, made)]))).cast(schema)

    return run


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """The columns of ``docs`` but text; n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = [c for c in docs.columns if c not in (*made, "text")]
    docs = packed(docs.drop(*made), "doc_id", "text", train=F.coalesce(learn, F.lit(False)))
    names = [c for c in docs.columns if c not in ("text", "train")]
    cut = BlockFiles(docs, BLOCK_BYTES, "text", _cut(names))
    parts = int(max(12, -(-cut.size // OWNER_TOKENS)))
    told = stored(cut.numbers().mapInArrow(_ask_words(parts, cut.reader()), _BLOBS).groupBy("pid").applyInArrow(_answer_words(parts), _BLOBS))
    n, v, top = told.agg(*[F.coalesce(f, F.lit(0)) for f in (F.sum("n"), F.sum("v"), F.max("top"))]).first()
    bits = max(LEAST_BITS, int(top).bit_length())
    words = told.select("block", "pid", "blob", F.lit(0).alias("kind"))
    grams = stored(cut.dealt(words).groupBy("block").applyInArrow(_ask_grams(parts, bits, cut.reader()), _BLOBS).groupBy("pid").applyInArrow(_answer_grams(bits), _BLOBS))
    answers = words.unionByName(grams.select("block", "pid", "blob", F.lit(1).alias("kind")))
    types = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(c, t) for c, t in zip(made, [T.LongType()] * 3 + [T.DoubleType()] * 2)]])
    scored = cut.dealt(answers).groupBy("block").applyInArrow(_score(parts, bits, n, v, cut.reader(), to_arrow_schema(types)), types)
    return unpacked(scored, own, *made)
