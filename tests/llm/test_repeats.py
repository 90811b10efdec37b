"""Repeated byte strings against plain Python."""

import random

from plumbline.llm import repeats

from tests.llm import brute


def test_repeats(spark):
    r = random.Random(9)
    rows = [x[:2] for x in {x[0]: x for x in brute.documents() if x[0] is not None}.values()]
    some = [t for _, t in rows if t and 200 < len(t) < 4000]
    for i in range(30):
        a, b = r.choice(some), r.choice(some)
        rows.append((1000 + i, a[r.randrange(60) :][: r.choice([45, 50, 51, 80, 300])] + r.choice(["", "é", "zz"]) + b[r.randrange(90) :][: r.choice([49, 50, 52, 120])]))
    rows += [(2000, "a" * 49), (2001, "a" * 50), (2002, "a" * 130), (2003, "b" + "a" * 60 + "c"), (-4, some[0][:70]), (2004, ("xy" * 30 + "-") * 5)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.repeats(rows)
    assert {x["doc_id"]: tuple(x)[1:] for x in got.collect()} == want
    assert sum(w[1] > 0 for w in want.values()) > 25
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = repeats.remove_repeats(spark.createDataFrame([(None, some[0]), (3, some[0]), (3, some[0])], "doc_id long, text string"))
    assert sorted((x["doc_id"] is None, x["n_removed"] > 0) for x in twice.collect()) == [(False, False), (False, False), (True, True)]
