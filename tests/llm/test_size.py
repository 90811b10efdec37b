"""What must hold at sizes that no test table has."""

import numpy as np
import pyarrow as pa
from plumbline.llm import langid, lm, repeats


def test_a_sample_of_very_many_rows_is_not_empty():
    for n in (6 * 10**9, 10**13):
        share = -(-langid.SHARES * langid.SAMPLE // n)
        assert 0.9 * langid.SAMPLE <= n * share / langid.SHARES <= 1.1 * langid.SAMPLE


def test_counts_beyond_32_bits():
    most, key = 2**31 - 1, np.array([7], np.uint64)
    count = np.array([most], np.int64)
    asked = lambda *x: lm._rows([0, 1, 2], [0] * 3, [lm._pack(*x)] * 3)
    out = lm._answer_words(1)((pa.scalar(0),), asked(key, count))
    for b in out.column("blob"):
        assert [x.tolist() for x in lm._unpack(b.as_py(), np.int64, np.int64)] == [[3 * most], [0]]
    grams = lm._answer_grams(16)((), asked(key, count, np.ones(1, np.uint32), np.array([9], np.uint64), count))
    for b in grams.column("blob"):
        assert [x.tolist() for x in lm._unpack(b.as_py(), np.int64, np.int64)] == [[3 * most]] * 2
    assert out.column("n").to_pylist() == [3 * most, 0, 0] and out.column("v").to_pylist() == [1, 0, 0]


def test_a_block_looks_at_its_own_shards_only():
    keys = np.array([5 << 16, 9 << 16, 5 << 16 | 1], np.uint64)
    owners = repeats.Owners(keys, 10**12)
    assert [(p, at.tolist()) for p, at in owners] == [(5, [0, 2]), (9, [1])] and owners.of(9).tolist() == [1]
    b = lm.Block(lm.word_hash([b"  ", b" ", b"a", b"b"]), np.array([2, 3, 1], np.int32), np.array([3]))
    words, grams = list(lm.dealt_words(b, 10**9)), list(lm.dealt_grams(b.grams(np.arange(4, dtype=np.uint64), 16), 16, 10**9))
    assert sum(len(w) for _, w in words) == 4 and sum(a.stop - a.start for _, a, _ in grams) == 3 and len(words) + len(grams) <= 7


def test_lanes_carry_the_state_of_one_pass():
    """Lanes of any length give what one token after another gives."""
    r = np.random.default_rng(8)
    sizes = r.integers(1, 40, 30)
    tokens = np.concatenate([np.append(r.integers(2, 9, s - 1), 1) for s in sizes]).astype(np.int32)
    b = lm.Block(lm.word_hash([bytes([65 + i]) * 2 for i in range(9)]), tokens, sizes)
    train = r.random(30) < 0.6
    words, (arcs, thirds) = b.words(train), b.grams(np.arange(9, dtype=np.uint64), 16).counts(train)
    auto = lm.Automaton(b, words, arcs, thirds, int(words[1:].sum()), int((words[1:] > 0).sum()))
    state, want = np.zeros(1, np.int64), []
    for first, t in zip(b.first, tokens):
        weight, state = auto.step(np.array([auto.begin]) if first else state, np.array([t], np.int64))
        want.append(weight[0])
    for lane in (1, 7, 256):
        old, lm.LANE = lm.LANE, lane
        try:
            assert np.allclose(auto.traverse(b), want)
        finally:
            lm.LANE = old
