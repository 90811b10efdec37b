"""Near copies at a Jaccard similarity of 0.8 or more, against all pairs in plain Python."""

import random

from plumbline.llm import minhash, simhash

from tests.llm import brute


def sets(rows):
    out = []
    for _, t in rows:
        w = brute.low(t).encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return out


def kept(rows):
    of, up = sets(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_all_pairs_from_0_8(spark):
    r = random.Random(3)
    rows = []
    for _ in range(40):
        w = [f"w{r.randrange(4000)}" for _ in range(r.randint(40, 400))]
        rows.append(" ".join(w))
        for _ in range(r.randint(1, 5)):  # chains too: each edit starts from the one before
            for _ in range(r.randint(1, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randrange(4000)}"
            rows.append(" ".join(w))
    hub = [f"h{i}" for i in range(300)]
    rows += [" ".join(hub[:i] + ["other"] + hub[i + 1 :]) for i in range(0, 300, 5)]
    rows = list(enumerate(rows))
    of = sets(rows)
    between = [(i, j) for i in range(len(rows)) for j in range(i) if 0.8 <= len(of[i] & of[j]) / len(of[i] | of[j]) < 0.97]
    want = kept(rows)
    assert len(between) > 50 and 40 < len(want) < len(rows) - 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.deduplicate(docs).collect()} == want


def test_long_texts_by_doubts(spark):
    """Sets that their sketches don't hold whole: chains of near copies, and pairs just below 0.8."""
    r = random.Random(8)
    rows = []
    for step in (6, 9, 14, 16, 18):
        w = [f"w{r.randrange(90_000)}" for _ in range(900)]
        for _ in range(14):
            rows.append(" ".join(w))
            for _ in range(step):
                w[r.randrange(len(w))] = f"x{r.randrange(90_000)}"
    r.shuffle(rows)
    rows = list(enumerate(rows))
    of = sets(rows)
    close = [len(of[i] & of[j]) / len(of[i] | of[j]) for i in range(len(rows)) for j in range(i)]
    assert min(map(len, of)) > minhash.LEAST and sum(0.72 < x < 0.8 for x in close) > 20 and sum(0.8 <= x < 0.95 for x in close) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.deduplicate(docs).collect()} == kept(rows)
