"""Near benchmark matches, whichever of a window's words were altered."""

import random

from plumbline.llm import decontam, queries


def test_altered_rarest_words(spark):
    items = [(f"i{k}", " ".join(f"t{k}x{i}" for i in range(10))) for k in range(4)]
    w = [t.split() for _, t in items]
    r = random.Random(4)
    rows = [(1, [*w[0][:3], "typo", *w[0][4:]])]  # t0x3 is nowhere else: absent from the corpus
    rows += [(2, [*w[1][:3], "typo", *w[1][4:]]), (3, ["y", w[1][3], "z"])]  # t1x3 is the rarest, in another text
    rows += [(4, ["typo", *w[2][1:9], "typo"]), (5, ["a", "b", "typo", *w[3][3:], "c"]), (6, list(w[3])), (7, ["p", *r.sample(w[2], 8), "q"])]
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string")
    found = decontam.judged(docs, spark.createDataFrame(items, "item_id string, text string"))
    got = {x["doc_id"]: (x["n_near"], x["contaminated"]) for x in found.collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (0, False), 4: (1, False), 5: (0, False), 6: (0, True), 7: (1, False)}


def test_against_all_positions(spark):
    r = random.Random(9)
    items = [(f"i{k}", " ".join(f"v{r.randrange(60)}" for _ in range(r.randint(4, 14)))) for k in range(25)]
    rows = []
    for d in range(150):
        x = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            x[r.randrange(len(x))] = f"v{r.randrange(80)}"
        rows.append((d, [f"v{r.randrange(200)}" for _ in range(20)] + x + [f"v{r.randrange(200)}" for _ in range(20)]))
    must = {}
    for d, x in rows:
        must[d] = set()
        for k, t in items:
            t = t.split()
            n = min(10, len(t))
            for win in (set(t[i : i + n]) for i in range(len(t) - n + 1)):
                if any(10 * len(win & set(x[p : p + 10])) >= 8 * len(win) for p in range(len(x))):
                    must[d].add(k)
    found = decontam.judged(spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    for x in found.collect():
        assert x["n_near"] + len(x["items"]) >= len(must[x["doc_id"]])
    assert sum(x["n_near"] for x in found.collect()) > 30


def test_query_returns_near(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r["n_near"], r["contaminated"]) for r in queries.op8_decontam(spark, str(tmp_path)).collect()] == [(1, False)]
