"""Operator 1: byte-level BPE encoding and decoding by tree concatenation.

Ordinary text is cut where the pre-tokenizer always cuts (before a single space between
two non-spaces), so the parts are independent. A stretch without such a cut is
pre-tokenized; a pre-token longer than a leaf is halved down to leaves, the leaves are
encoded in parallel threads, and each join is repaired by encoding a growing window of
tokens around it again until the window's first and last token equal the neighbours'
own tokens. A token sequence whose adjacent pairs are each the encoding of their own
text is the encoding of the whole, so the result is exact.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the
empty string; every other column of the input, nulls and repeated rows included, is kept.
A column named like an output is replaced. Special-token strings inside a text become the
special id, as the tokenizer's own encode does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LEAF = 16_384  # bytes of a leaf of the tree, and characters between two plain cuts
THREADS = 2  # of a worker for long pre-tokens
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        back = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self._bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._pre = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf = leaf
        self._pool: ThreadPoolExecutor | None = None  # made for the first long pre-token of the worker

    def encode(self, text: str) -> list[int]:
        if self._special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self._special.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._bpe.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + self.leaf)
            end = cut.start() if cut else len(text)
            out += self._bpe.encode_ordinary(text[at:end]) if end - at <= 2 * self.leaf else self._unsplit(text[at:end])
            at = end
        return out

    def _unsplit(self, text: str) -> list[int]:
        out: list[int] = []
        for _, (a, b) in self._pre.pre_tokenize_str(text):
            piece = text[a:b].encode()
            out += self.tree(piece) if len(piece) > self.leaf else self._bpe._encode_single_piece(piece)
        return out

    def tree(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, from the ids of its halves."""
        n = max(1, 1 << (-(-len(piece) // self.leaf) - 1).bit_length())
        cuts = [len(piece) * i // n for i in range(n + 1)]
        self._pool = self._pool or ThreadPoolExecutor(THREADS)
        level = list(self._pool.map(lambda i: self._bpe._encode_single_piece(piece[cuts[i] : cuts[i + 1]]), range(n)))
        while len(level) > 1:
            level = list(self._pool.map(self.join, level[::2], level[1::2]))
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        w = 4
        while True:
            a, b = left[-w:], right[:w]
            mid = self._bpe._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, a + b)))
            if (w >= len(left) or mid[0] == a[0]) and (w >= len(right) or mid[-1] == b[-1]):
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            w *= 2


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path)


def _mapped(df: DataFrame, path: str, column: str, add: list[tuple[str, T.DataType]], work) -> DataFrame:
    names = {n for n, _ in add}
    kept = df.select(*[c for c in df.columns if c not in names or c == column])
    out = T.StructType([f for f in kept.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in add])
    arrow = pa.schema([pa.field(n, pa.list_(pa.int32()) if isinstance(t, T.ArrayType) else pa.string()) for n, t in add])
    order = [f.name for f in out.fields[: -len(add)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # bounds what is held at a time
                part = batch.slice(a, 512)
                made = work(c, part.column(column).to_pylist())
                arrays = [part.column(n) for n in order] + [pa.array(x, f.type) for x, f in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=order + arrow.names)

    return kept.mapInArrow(run, out)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text``."""
    return _mapped(df, tokenizer_path, text, [(ids, T.ArrayType(T.IntegerType()))], lambda c, xs: [[c.encode(x or "") for x in xs]])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``."""
    return _mapped(df, tokenizer_path, ids, [(text, T.StringType())], lambda c, xs: [[c.decode(x or []) for x in xs]])


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass over the rows, so the ids cross to Python and back once."""

    def work(c: Codec, xs: list) -> list:
        made = [c.encode(x or "") for x in xs]
        return [made, [c.decode(x) for x in made]]

    return _mapped(df, tokenizer_path, text, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], work)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the rows of ``encode_decode``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
