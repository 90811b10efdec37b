"""Operator 11 against plain Python: cuts, forms, the index and odd rows."""

import hashlib
import math
import random

import pytest
from plumbline.llm import fim
from pyspark.sql import functions as F

from tests.llm import brute


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def key(rows):
    return sorted(rows, key=repr)


ODD = [(100 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M>", "<", "<<P", "P>", "é<😀>S> <M é", "\x00", "日本", "😀" * 700, "a" * 9])] + [(None, "no id"), (None, None), (5, "same"), (5, "same")]


def test_rows(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in brute.documents()] + ODD + [(i, "<S a copy of a text é") for i in range(300, 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(fim, "ROWS", 16)  # so that the copies are dealt to several tasks
    made = fim.transform(docs).cache()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
    assert key(got) == key(plain(*r) for r in rows)
    assert made.filter(~F.col("text").eqNullSafe(fim.restored(F.col("output"), F.col("form")))).filter("text is not null").count() == 0
    assert key((r.doc_id, r.text) for r in made.collect()) == key(rows)
    want = key((p[0], brute.sha(p[5]), brute.sha(r[1] or "")) for r in rows for p in [plain(*r)])
    assert key((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect()) == want


def test_empty_table(spark):
    made = fim.transform(spark.createDataFrame([], "doc_id long, text string, output int"))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"] and made.count() == 0


def test_texts_of_one_hash(spark):
    """Texts are told apart by their bytes, not by their hash."""
    import pyarrow as pa

    texts = ["abc", "é", "abc", "", "é"]
    batch = pa.RecordBatch.from_pydict({"_key": [1] * 5, "_text": [t.encode() for t in texts], "form": ["psm"] * 5, "_h1": [1] * 5, "_h2": [2] * 5})
    out = list(fim._cut(iter([batch]), pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])))
    assert out[0].column(0).to_pylist() == [3, 1, 3, 0, 1]


@pytest.mark.parametrize("alphabet", ["ab", "é", "日", "😀", "aé日😀"])
@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_boundaries(alphabet, n, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 97)
    r = random.Random(n)
    text = "".join(r.choice(alphabet) for _ in range(n))
    b = fim.Boundaries(text.encode())
    assert b.n == n and [b.select(i) for i in range(n + 1)] == [len(text[:i].encode()) for i in range(n + 1)]
    per = 2 + math.ceil(math.log2(max(1, len(text.encode()) / max(n, 1))))
    assert 8 * (len(b.ones) + len(b.low)) <= per * n + 64
