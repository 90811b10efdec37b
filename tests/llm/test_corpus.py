"""SimHash, language ID, line dedup, decontamination and LM scoring against plain Python."""

import math
import zlib
from collections import Counter

import pytest
from plumbline.llm import decontam, graph, langid, linedup, lm, queries, simhash
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_simhash(spark, docs):
    rows = [(r[0], r[1]) for r in brute.documents()]
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    same(map(tuple, got), [(d, f, c) for (d, _), (f, c) in zip(rows, brute.components(rows))])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_simhash_links_all_near_pairs(spark):
    import random

    r = random.Random(2)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = graph.star_components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), len(fps))).collect()
    root = {r["node"]: r["root"] for r in got}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    for i in range(len(fps)):
        for j in range(i):
            assert (find(i) == find(j)) == (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j]))


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 101), (7, 7), (200, -5)]
    got = {r["node"]: r["root"] for r in graph.star_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[x] for x in (100, 90, 101)} == {90} and got[200] == -5 and 7 not in {k for k in got if k == 7 and got[k] != 0}


def test_decontamination(spark, docs):
    rows = brute.documents()
    long = [r for r in rows if r[1] and len(r[1].split()) > 60]
    items = [(f"i{k}", " ".join(r[1].split()[5 : 5 + 12 + k])) for k, r in enumerate(long[:6])] + [("s", "B C"), ("n", None), ("e", " .. "), ("s", "b, c"), ("o", "日本語テキスト")]
    found = decontam.judged(docs, spark.createDataFrame(items, "item_id string, text string"))
    want = [(r[0], *brute.contamination(r[1], items)) for r in rows]
    same(map(tuple, decontam.digests(found).collect()), want)
    assert sum(w[-1] for w in want) > 4
    none = decontam.judged(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    assert decontam.judged(docs.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_language_id(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_langid(spark, d).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "the", None), (5, "the of and", "en")], "doc_id long, text string, lang string")
    by = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and len(by) == 5 and all(0 <= r["score"] <= 1 for r in by.values())
    assert {r["lang_pred"] for r in langid.identify(odd.filter("lang is null")).collect()} == {"und"}


def test_line_dedup(spark, docs):
    rows = brute.documents()
    out = linedup.dedup_lines(docs)
    assert out.count() == len(rows) and out.columns == [*docs.columns, "n_chunks_removed"]
    pieces = docs.select("doc_id", "text", linedup.chunks(F.col("text")).alias("c")).collect()
    assert all(r["text"] is None or "\n".join(x["body"] for x in r["c"]) == r["text"] for r in pieces)
    seen, want = set(), []
    of = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        if r["text"] is None:
            want.append((r["doc_id"], None))
            continue
        if (r["doc_id"], r["text"]) in of:
            want.append((r["doc_id"], of[r["doc_id"], r["text"]]))
            continue
        left = []
        for c in r["c"]:
            if sum(bool(brute.SP.search(x)) for x in c["body"].split("\n")) >= 2:
                if c["body"] in seen:
                    continue
                seen.add(c["body"])
            left.append(c["body"])
        of[r["doc_id"], r["text"]] = "\n".join(left)
        want.append((r["doc_id"], of[r["doc_id"], r["text"]]))
    same([(r["doc_id"], r["text"]) for r in out.collect()], want)
    assert out.filter("n_chunks_removed > 0").count() > 5


def test_lm(spark, docs):
    rows = brute.documents()
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    got = lm.score(docs, ~out).collect()
    toks = lambda t: [*brute.words(brute.low(t)), None]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    uni, bi, tri, one, two = (Counter() for _ in range(5))
    grams = lambda t: list(zip([None, "<s>", *t], ["<s>", *t], t))
    for r, h in zip(rows, held):
        if not h:
            t = toks(r[1])
            uni.update(t)
            bi.update((b, c) for _, b, c in grams(t))
            one.update(b for _, b, _ in grams(t))
            tri.update(grams(t)[1:])
            two.update((b, c) for _, b, c in grams(t))
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda b, c: (bi[b, c] + lm.MU[0] * p(c)) / (one[b] + lm.MU[0])
    p3 = lambda a, b, c: (tri[a, b, c] + lm.MU[1] * p2(b, c)) / (two[a, b] + lm.MU[1]) if a and two[a, b] else p2(b, c)
    want = []
    for r in rows:
        t = toks(r[1])
        s = sum(math.log10(p3(*g)) for g in grams(t))
        want.append((r[0], len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10(p(w)) for w in t), 5), round(s, 5)))
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got], want)
    assert lm.score(docs.limit(0), ~out).count() == 0
    assert lm.score(docs, F.lit(False)).agg(F.sum("n_known")).first()[0] == 0
