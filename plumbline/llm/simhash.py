"""Operator 3: SimHash near-duplicates by meet-in-the-middle ball hashing.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one row
from then on. Two fingerprints at most 3 bits apart meet at a common variant: every one
emits itself and its 64 one-bit variants; of two that differ in an odd number of bits one
has even parity, and the even ones also emit two-bit variants. Of any three bits two lie in
the same half of the word, so pairs of bits within a half are enough (992 of 2,016).

Variants are dealt by a hash. At one variant every member is within 2 bits of it; where some
member is within 1 bit, it is within 3 bits of all others, so a star around it links them
all; where all are 2 bits away, pairs within reach also meet at another variant. So a bucket
gives one link a member, never all pairs. Links are verified by distance, reduced to a
forest a partition, and joined into components by distributed star contraction.

Defined cases: null, empty and wordless texts have fingerprint 0, linked like any other; a
text of fewer words than a shingle has one shingle; repeated rows share a fingerprint; null
doc_ids take part but are never a component's id (a component of null ids alone has a null
id); other columns are ignored by ``near_duplicates``. ``deduplicate``, the pipeline's stage,
checks what meets by its texts and adds candidates from ``minhash``: 3 bits reach a similarity of
about 0.97 only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import minhash
from .common import drop_stored, packed, stored, unpacked
from .graph import star_components

BITS, RADIUS = 64, 3
ENTRIES = 2_000_000  # variants a reduce partition holds, so memory stays the same at any size
BATCH = 8_192
SPREAD = 16_384  # fingerprints a task makes variants of

_ONE = [1 << i for i in range(64)]
#: No flip, one flip, then two flips within a half.
MASKS = np.array([0, *_ONE, *[a | b for h in (0, 32) for i, a in enumerate(_ONE[h : h + 32]) for b in _ONE[h + i + 1 : h + 32]]], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64 bits: each set where over half the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    sums = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        h = np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts[a : a + 65_536], stops[a : a + 65_536])), np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _deal(parts: int):
    """Rows (pid, blob); a blob lists fingerprints, how many variants each has there, and
    the variants as mask numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                fps = b.column(0).slice(a, BATCH).to_numpy(zero_copy_only=False).view(np.uint64)
                even = np.bitwise_count(fps) % 2 == 0
                who = np.concatenate((np.repeat(np.flatnonzero(even), len(MASKS)), np.repeat(np.flatnonzero(~even), 65)))
                mask = np.concatenate((np.tile(np.arange(len(MASKS)), int(even.sum())), np.tile(np.arange(65), int((~even).sum())))).astype(np.uint16)
                pid = ((mixed(fps[who] ^ MASKS[mask]) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)
                order = np.lexsort((mask, who, pid)) if parts > 65_535 else np.argsort(pid.astype(np.uint16), kind="stable")
                pid, who, mask = pid[order], who[order], mask[order]
                cuts = np.flatnonzero(np.diff(pid)) + 1
                pids, blobs = [], []
                for i, j in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(pid)]))):
                    if i == j:
                        continue
                    w, first, n = np.unique(who[i:j], return_index=True, return_counts=True)
                    by = np.argsort(first)
                    pids.append(int(pid[i]))
                    blobs.append(np.uint32(len(w)).tobytes() + fps[w[by]].tobytes() + n[by].astype(np.uint16).tobytes() + mask[i:j].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(blobs, pa.binary())], names=["pid", "blob"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) with the same components as the links (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        if (new == up).all():
            break
        up = new
    far = up != np.arange(len(nodes))
    return nodes[up[far]], nodes[far]


def _meet(table: pa.Table) -> pa.Table:
    fps, masks = [], []
    for blob in table.column("blob"):
        raw = blob.as_buffer()
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        f = np.frombuffer(raw, np.uint64, n, 4)
        c = np.frombuffer(raw, np.uint16, n, 4 + 8 * n)
        fps.append(np.repeat(f, c))
        masks.append(np.frombuffer(raw, np.uint16, -1, 4 + 10 * n))
    fp, mask = np.concatenate(fps), np.concatenate(masks)
    key = fp ^ MASKS[mask]
    order = np.lexsort((mask > 64, key))  # at each variant those within one bit come first
    key, fp, near = key[order], fp[order], mask[order] <= 64
    start = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    ok = near[head] & (fp[head] != fp)
    a, b = fp[head][ok], fp[ok]
    ok = np.bitwise_count(a ^ b) <= RADIUS
    root, member = forest(a[ok], b[ok]) if ok.any() else (a[:0], b[:0])
    return pa.table({"a": root.view(np.int64), "b": member.view(np.int64)})


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within reach; ``distinct`` has
    one row for each fingerprint, ``n`` of them."""
    parts = max(16, math.ceil(n * (len(MASKS) + 65) / 2 / ENTRIES))
    spread = distinct.select("fp").repartition(max(16, math.ceil(n / SPREAD)))  # few bytes now, hundreds of times as many below
    return spread.mapInArrow(_deal(parts), "pid int, blob binary").groupBy("pid").applyInArrow(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = stored(fingerprints(docs, shingle))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = star_components(links(distinct, distinct.count()))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored(rooted.join(least, "root").select("fp", "component_id"))
    drop_stored(distinct)
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_copies(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """Links (a, b) between sets of shingles whose SimHashes meet in the ball of ``RADIUS`` bits and
    whose texts have a Jaccard similarity of 0.8 or more; ``rows`` are those of ``minhash.marked``,
    stored. Sets of one fingerprint link to its smallest, that to its neighbours'."""
    sets = stored(rows.groupBy("_set").agg(F.min("_row").alias("_row"), F.min("_fp").alias("fp")))
    reps = stored(sets.groupBy("fp").agg(F.min("_set").alias("rep")))
    at = lambda n: reps.select(F.col("fp").alias(n), F.col("rep").alias(f"_{n}")).hint("merge")
    met = links(reps, reps.count()).join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = sets.join(reps.hint("merge"), "fp").filter("_set <> rep").select(F.col("rep").alias("a"), F.col("_set").alias("b"))
    pairs = stored(met.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    held = pairs.select(F.explode(F.array("a", "b")).alias("_set")).distinct()
    chosen = sets.join(held.hint("merge"), "_set", "left_semi").select("_row")
    texts = stored(rows.select("_row", "_set", "text").join(chosen.hint("merge"), "_row", "left_semi").select("_set", "text"))
    out = stored(minhash.linked(pairs, texts, shingle))
    for done in (sets, reps, pairs, texts):
        drop_stored(done)
    return out


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with exactly one row for each group of near copies, that of the smallest doc_id
    (a null one comes last): texts are near copies where their sets of shingles have a Jaccard
    similarity of 0.8 or more. The ball hashing finds those whose fingerprints are within ``RADIUS``
    bits (from about 0.97), the bands of ``minhash`` all others. Repeated rows and rows without a
    doc_id are rows like others."""
    rows = stored(minhash.marked(packed(docs, "doc_id", "text", _row=F.monotonically_increasing_id()), shingle))
    roots = minhash.components(rows, shingle, near_copies(rows, shingle)).hint("merge")
    rooted = rows.select("doc_id", "_row", "_set").join(roots, "_set", "left").withColumn("root", F.coalesce("root", "_set"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row").alias("_row"))
    kept = rooted.groupBy("root").agg(F.min(first).alias("k")).select("k._row")
    return unpacked(rows.join(kept.hint("merge"), "_row", "left_semi"), docs.columns)
