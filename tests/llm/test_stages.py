"""Each pipeline stage against plain Python, on odd rows and on empty tables."""

import corpus_pipeline as pipe
import pytest
from plumbline.llm import langid
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_minhash import sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, n_words string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    long = [r for r in brute.documents() if r[1] and len(r[1].split()) > 60]
    items = [(k, " ".join(r[1].split()[5 : 5 + 12 + k])) for k, r in enumerate(long[:4])] + [(9, None), (None, "B C")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def rows():
    """Odd rows, with more without a doc_id, repeated ones, and names that operators use."""
    made = brute.documents()
    some = [r for r in made if r[1] and len(r[1].split()) > 60]
    made += [(None, "only here " * 9 + " without an id", None, "s", 0), made[20], made[20], (None, some[0][1], "en", "s", 0), (None, some[0][1], "en", "s", 0)]
    return [(*r, i, f"w{i}") for i, r in enumerate(made)]


def test_empty(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipe.STAGES:
        out = stage(spark, empty, folder[0])
        assert out.count() == 0 and (name == "encode" or out.columns == empty.columns), name


def test_language_id(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = {r["n_words"]: r for r in pipe.language_id(spark, docs, folder[0]).collect()}
    net = langid.fit(docs, ~langid.held_out(F.col("doc_id")))
    told = {r["n_words"]: r for r in langid.predict(docs, net, ["n_words", "text", "lang"]).collect()}
    want = {k: r for k, r in told.items() if r["lang_pred"] != "und" and r["score"] >= pipe.MIN_SCORE}
    assert set(out) == set(want) and len(out) > 40
    assert all(r["lang"] == (rows()[int(k[1:])][2] or want[k]["lang_pred"]) for k, r in out.items())
    bare = pipe.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), folder[0])
    assert bare.count() == sum(langid.has_letter(r[1]) for r in rows()) and bare.filter("lang is not null").isEmpty()


def passages(made):
    """(text, whether lines went) of each row by plain Python."""
    def runs(t):
        ls = t.split("\n")
        at = [i for i, x in enumerate(ls) if brute.SP.search(x)]
        return ls, [(a, b, "\n".join(ls[a : b + 1])) for a, b in zip(at, at[1:])]

    import struct

    import xxhash

    def key(r):
        if r[0] is not None:
            return (1, r[0], 0)
        return (0, 0, struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(r[1].encode(), 42)))[0])

    first, texts = {}, [(key(r), r[1]) for r in made if r[1] is not None]
    for k, t in texts:
        for a, _, body in runs(t)[1]:
            first[body] = min(first.get(body, (k, a)), (k, a))
    out = []
    for r in made:
        if r[1] is None:
            out.append((None, False))
            continue
        ls, rs = runs(r[1])
        gone = {i for a, b, body in rs if (key(r), a) > first[body] for i in range(a, b + 1)}
        left = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((r[1] if not gone else left if brute.SP.search(left) else "", bool(gone)))
    return out


def test_line_dedup(spark, folder):
    made = [r for r in rows() if r[0] != 7]  # ids that repeat with other texts are versions of one document
    out = pipe.line_dedup(spark, spark.createDataFrame(made, SCHEMA), folder[0])
    want = sorted((r[6], t, len(t) if cut else r[4]) for r, (t, cut) in zip(made, passages(made)) if not (cut and not t.strip()))
    assert sorted((r["n_words"], r["text"], r["n_chars"]) for r in out.collect()) == want and out.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_near_dedup(spark, folder):
    made = rows()
    out = pipe.near_dedup(spark, spark.createDataFrame(made, SCHEMA), folder[0]).collect()
    of, up = [s if s != {()} else frozenset() for s in map(frozenset, sets([(r[0], r[1]) for r in made]))], list(range(len(made)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            if 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]):
                up[find(i)] = find(j)
    groups = brute.grouped([(find(i), r) for i, r in enumerate(made)], 0)
    assert len(out) == len(groups)
    least = lambda rs: min((r[0] is None, r[0] or 0) for _, r in rs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted(map(least, groups.values()))
    assert any(r["doc_id"] is None for r in out)


def test_decontaminate(spark, folder):
    d, items = folder
    out = pipe.decontaminate(spark, spark.createDataFrame(rows(), SCHEMA), d)
    want = sorted(r[6] for r in rows() if not brute.contamination(r[1], [(i, t) for i, t in items if t])[-1])
    assert sorted(r["n_words"] for r in out.collect()) == want and len(want) < len(rows())


def test_encode(spark, folder):
    out = pipe.encode(spark, spark.createDataFrame(rows(), SCHEMA), folder[0]).collect()
    assert len(out) == len(rows()) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
