"""Operator 11: fill-in-middle transformation over a distinct-text index.

Documents are dealt by a hash of their text, so that all copies of a text meet. In a task the
texts of one hash are told apart by their bytes; each distinct one gets an entry in the index:
its number of code points and the list of the byte offsets where they begin, in Elias-Fano form
(about two bits a code point). Every document of that text then selects its two seeded cuts from
the list, which costs the same wherever they are.

Rows of a hash that many documents share are dealt to several tasks by their ids. Which hashes
those are is counted first; they are fewer than ``HOT_KEYS``, because each has more than that
share of all rows, and so may be broadcast. Within a task rows come sorted by hash, one batch at a
time: the index holds the texts of one hash, never those of a partition.

Defined cases: a null or empty text has form ``plain`` and no units; a null doc_id is drawn as an
empty one; repeated rows each give a row; a text that holds a marker is plain; texts of any length
are cut whole (offsets are found in pieces of ``PIECE`` bytes); other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import packed, unpacked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents so many are cut, and so many of these suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Rows of one text to a task, about; and the most hashes that are dealt so.
ROWS, HOT_KEYS = 1024, 1 << 16
PIECE = 1 << 20
#: Set bits between two samples of their places.
SAMPLE = 512


class Boundaries:
    """The offsets where the code points of UTF-8 bytes begin, and the end, as an Elias-Fano list:
    the low bits of each offset side by side, and its high part as a one after as many zeros."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        begins = [(raw[a : a + PIECE] & 0xC0) != 0x80 for a in range(0, len(raw), PIECE)] if len(raw) <= PIECE else None
        pieces = range(0, len(raw), PIECE)
        starts = lambda a: begins[0] if begins else (raw[a : a + PIECE] & 0xC0) != 0x80
        self.n = sum(int(np.count_nonzero(starts(a))) for a in pieces)
        self.low_bits = max(0, ((len(raw) + 1) // (self.n + 1)).bit_length() - 1)
        ones = np.zeros(((len(raw) >> self.low_bits) + self.n + 8) // 8 + 1, np.uint8)
        low = np.zeros(((self.n + 1) * self.low_bits + 7) // 8 + 1, np.uint8)
        places, done = [], 0
        for a in [*pieces, len(raw)]:
            at = np.flatnonzero(starts(a)) + a if a < len(raw) else np.array([len(raw)])
            if not len(at):
                continue
            order = np.arange(done, done + len(at))
            high = (at >> self.low_bits) + order
            _set(ones, high)
            for b in range(self.low_bits):
                _set(low, order[(at >> b) & 1 == 1] * self.low_bits + b)
            places.append(high[(-done) % SAMPLE :: SAMPLE])
            done += len(at)
        self.ones, self.low, self.places = ones, low, np.concatenate(places)

    def select(self, i: int) -> int:
        """The byte offset of boundary ``i``, 0 to n."""
        at, left = int(self.places[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        while True:
            bits = np.flatnonzero(np.unpackbits(self.ones[byte : byte + SAMPLE // 2], bitorder="little")[skip:])
            if left < len(bits):
                high = (byte << 3) + skip + int(bits[left]) - i
                break
            left, byte, skip = left - len(bits), byte + SAMPLE // 2, 0
        value = high << self.low_bits
        for b in range(self.low_bits):
            k = i * self.low_bits + b
            value |= int(self.low[k >> 3] >> (k & 7) & 1) << b
        return value


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets rising places in packed bits."""
    if len(at):
        first = int(at[0]) >> 3
        flags = np.zeros(int(at[-1]) + 1 - (first << 3), bool)
        flags[at - (first << 3)] = True
        made = np.packbits(flags, bitorder="little")
        bits[first : first + len(made)] |= made


def _draws(seed: int) -> list[Column]:
    """Four numbers from the first 32 hexadecimal digits of a hash of the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _form(text: Column, draws: list[Column]) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (draws[2] % 100 >= CUT), "plain").when(draws[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def _written(form: str, data: bytes, a: int, b: int) -> bytes:
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    return data if form == "plain" else b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, index = None, {}
    for batch in batches:
        n, ends, outputs = [], [], []
        for k, text, form, h1, h2 in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("_key", "_text", "form", "_h1", "_h2"))):
            if (k := k.as_py()) != key:
                key, index = k, {}
            data, form = text.as_buffer().to_pybytes(), form.as_py()
            entry = index.get(data)
            if entry is None:
                entry = index[data] = Boundaries(data)
            n.append(entry.n)
            u, v = sorted((h1.as_py() % (entry.n + 1), h2.as_py() % (entry.n + 1)))
            ends.append((u, v) if form != "plain" else (None, None))
            outputs.append(_written(form, data, entry.select(u), entry.select(v)) if form != "plain" else data)
        made = {"n": pa.array(n, pa.int64()), "prefix_chars": pa.array([e[0] for e in ends], pa.int64()), "middle_chars": pa.array([None if e[0] is None else e[1] - e[0] for e in ends], pa.int64()), "output": pa.array(outputs, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name)) for f in schema], schema=schema)


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with n (code points), form, prefix_chars, middle_chars and output, the text as it
    is to be trained on; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in names]), "doc_id", "text", _key=F.xxhash64("text"))
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = counts.filter(F.col("_n") > ROWS).join(F.broadcast(total)).filter(F.col("_n") * HOT_KEYS > F.col("_all")).select(F.col("_key").alias("_hot"), F.ceil(F.col("_n") / ROWS).alias("_parts"))
    text, draws = F.coalesce("text", F.lit("")), _draws(seed)
    rows = rows.join(F.broadcast(hot), rows["_key"] == hot["_hot"], "left")
    rows = rows.withColumns({"_part": F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_parts")), F.lit(0)), "form": _form(text, draws), "_h1": draws[0], "_h2": draws[1], "_null": F.col("text").isNull(), "_text": text.cast("binary")})
    dealt = rows.drop("_hot", "_parts", "text").repartition("_key", "_part").sortWithinPartitions("_key").drop("_part")
    kept = [f for f in dealt.schema if f.name in ("doc_id", "_rest", "_null")]
    made = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    schema = T.StructType([*kept, *made])
    arrow = to_arrow_schema(schema)
    out = dealt.mapInArrow(lambda batches: _cut(batches, arrow), schema)
    return unpacked(out.withColumn("text", F.when(~F.col("_null"), restored(F.col("output"), F.col("form")))), names, *[f.name for f in made])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a cut text holds no marker of its own, so the three
    markers part it into an empty piece and three others."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    p, s, m = (F.when(form == "psm", F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(b))) for a, b in ((1, 2), (2, 1), (3, 3)))
    return F.when(form == "plain", output).otherwise(F.concat(p, m, s))


def digests(made: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(text).alias("restored_sha256"))
