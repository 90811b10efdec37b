"""Words whose hashes agree in part, and keys of pairs."""

import numpy as np
import pytest
from plumbline.llm import lm
from pyspark.sql import functions as F


def test_keys_are_a_bijection():
    n = 1 << 10
    a, b = (x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(n), np.arange(n)))
    for bits in (10, 16, 31, 32):
        assert len(np.unique(lm.spread(a, b, bits))) == n * n and int(lm.spread(a, b, bits).max()) < 1 << 2 * bits


def test_words_that_agree_in_32_bits(spark):
    """Two words of which the lower 32 bits of the hash are equal keep counts of their own."""
    one, two, other = "w18172", "w23947", "w00001"
    low = lambda w: int(lm.word_hash([w.encode()])[0]) & 0xFFFFFFFF
    assert low(one) == low(two) != low(other)

    def scores(second):
        texts = [f"x y {one}"] * 3 + [f"x y {second}"] * 9
        rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[-1])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 100).collect() if r.doc_id >= 100}

    got, want = scores(two), scores(other)
    assert got == pytest.approx(want) and got[101] > got[100]
