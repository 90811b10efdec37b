"""Repeated passages of lines go whole, against plain Python and on planted ones."""

import random

from plumbline.llm import linedup

from tests.llm import brute


def cut(rows):
    """{doc_id: text} with every later occurrence of two lines with words in a row taken out."""
    runs, first = {}, {}
    for d, t in sorted(rows):
        ls = t.split("\n")
        at = [i for i, x in enumerate(ls) if brute.SP.search(x)]
        runs[d] = [(i, j, "\n".join(ls[i : j + 1])) for i, j in zip(at, at[1:])]
        for i, _, body in runs[d]:
            first.setdefault(body, (d, i))
    out = {}
    for d, t in rows:
        ls = t.split("\n")
        gone = {k for i, j, body in runs[d] if first[body] < (d, i) for k in range(i, j + 1)}
        left = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out[d] = left if not gone or brute.SP.search(left) else ""
    return out


def test_planted_passages(spark):
    r = random.Random(8)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(3, 9)))
    planted = [[line() for _ in range(r.randint(2, 7))] for _ in range(60)]
    own = [[line() for _ in range(r.randint(1, 6))] for _ in range(120)]
    lines = [own[i][: len(own[i]) // 2] + planted[i % 60] + own[i][len(own[i]) // 2 :] for i in range(120)]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    out = {x["doc_id"]: x for x in linedup.dedup_passages(docs).collect()}
    for i in range(120):
        assert out[i]["text"] == "\n".join(lines[i] if i < 60 else own[i]) and out[i]["n_chunks_removed"] == (i >= 60)


def test_against_python(spark):
    seen = {d: t for d, t, *_ in brute.documents() if d is not None and t is not None}
    rows = [*seen.items(), (900, "p q\n\n \nr s\nx"), (901, "\ny\np q\n\n \nr s\n\nz"), (902, "\n p q"), (903, "a a\na a\na a"), (904, "p q\n\nr s"), (905, "\np q\n\n \nr s\n")]
    got = linedup.dedup_passages(spark.createDataFrame([*rows, (906, None)], "doc_id long, text string")).collect()
    want = cut(rows)
    assert {x["doc_id"]: x["text"] for x in got} == want | {906: None}
    assert sum(x["n_chunks_removed"] > 0 for x in got) > 10 and want[901] == "\ny\n\nz" and want[905] == ""
