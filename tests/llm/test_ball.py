"""Ball hashing on sets of shingles, as the pipeline's stage uses it."""

import random

from plumbline.llm import minhash, simhash
from plumbline.llm.common import stored
from pyspark.sql import functions as F


def test_near_copies(spark):
    r = random.Random(11)
    texts = []
    for _ in range(20):
        w = [f"w{r.randrange(9999)}" for _ in range(400)]
        texts.append(" ".join(w))
        for _ in range(3):
            w[r.randrange(400)] = "edit"
            texts.append(" ".join(w))
    texts += [texts[0], "", None, texts[5].upper()]
    rows = stored(minhash.marked(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, text string")))
    made = {x["_row"]: x for x in rows.collect()}
    sets = {x["_set"]: minhash.shingles(x["text"]) for x in made.values()}
    fp = {x["_set"]: x["_fp"] % 2**64 for x in made.values()}
    got = {tuple(x) for x in simhash.near_copies(rows).collect()}
    up = {s: s for s in sets}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for a, b in got:
        assert (fp[a] ^ fp[b]).bit_count() <= 6 and minhash.alike(sets[a], sets[b])  # by way of one representative
        up[find(a)] = find(b)
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert len(near) > 20 and all(find(a) == find(b) for a, b in near if minhash.alike(sets[a], sets[b]))
    assert len({x["_set"] for x in made.values()}) == len(texts) - 3 and rows.filter(F.col("_fp") == 0).count() >= 2
