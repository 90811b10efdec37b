"""External suffix sorting against plain sorting."""

import random

import numpy as np
import pytest

import pyarrow as pa
from plumbline.llm import repeats, suffixes


def plain(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for p, q in zip(order, order[1:]):
        k = 0
        while k < cap and max(p, q) + k < len(text) and text[p + k] == text[q + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("block, limit", [(1 << 20, suffixes.LIMIT), (1 << 20, 0), (3, 200), (1, 0)])
def test_suffixes(monkeypatch, tmp_path, block, limit):
    """Small blocks and limits send every queue to disk and every level into recursion."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    r = random.Random(block + limit)
    texts = [b"", b"a", b"a" * 70, b"ab" * 40, b"abc" * 20 + b"abd" * 20, bytes(range(256))]
    texts += [bytes(r.choice(b"ab" if i % 2 else b"abcde") for _ in range(r.randrange(60))) * r.choice([1, 1, 3]) for i in range(80)]
    for t in texts:
        chars = [c + 1 for c in t] + [0]
        for cap in (3, 50):
            got = list(suffixes.sorted_suffixes(np.array(chars, np.uint16), cap, suffixes.Spill(limit, f"file://{tmp_path}/s")))
            assert (np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got]).tolist()) == plain(chars, cap)
    assert not list((tmp_path / "s").iterdir())


def test_spill(monkeypatch, tmp_path):
    """A text beyond the limit gives what it gives in memory."""
    monkeypatch.setattr(suffixes, "BLOCK", 4096)
    r = np.random.default_rng(3)
    words = [r.integers(2, 28, r.integers(2, 9)) for _ in range(300)]
    chars = np.append(np.concatenate([np.append(words[i], 1) for i in r.integers(0, 300, 8000)]), 0).astype(np.uint16)
    a, b = (list(suffixes.sorted_suffixes(chars, 50, s)) for s in (None, suffixes.Spill(50_000, f"file://{tmp_path}/s")))
    for k in (0, 1):
        assert np.array_equal(np.concatenate([x[k] for x in a]), np.concatenate([x[k] for x in b]))


def test_least_of_starts():
    """Starts of all contexts with the same K bytes get the smallest doc_id of them."""
    r = random.Random(4)
    seed = bytes(r.randrange(3) for _ in range(200))
    texts = [seed.decode(), (seed[20:150] + b"zz" + seed[60:]).decode(), "", "a" * 90]
    row, _ = repeats._cut(0, pa.table({"doc_id": [0, 1, 2, 3], "text": texts}))
    block = repeats.Block({n: row.column(n) for n in row.column_names})
    rows = block.contexts(np.arange(len(block.anchors)))
    least = np.array([r.randrange(50) for _ in rows], np.int64)
    strings = {}
    for x, d in zip(rows, least):
        for j in range(repeats.SIDE - x[-2], repeats.SIDE - int(x[-2]) + int(x[-1]) - repeats.K + 1):
            s = x[j : j + repeats.K].tobytes()
            strings[s] = min(strings.get(s, repeats.LAST), d)
    got = repeats.least_of_starts(rows, least)
    for x, g in zip(rows, got):
        for j in range(repeats.SIDE + 1):
            ok = repeats.SIDE - x[-2] <= j <= repeats.SIDE - int(x[-2]) + int(x[-1]) - repeats.K
            assert g[j] == (strings[x[j : j + repeats.K].tobytes()] if ok else repeats.LAST)


def test_can_share():
    """Only contexts that hold no 50 bytes of another are left out of the sort."""
    r = random.Random(8)
    gram, alike, other = (bytes(r.randrange(97, 123) for _ in range(n)) for n in (repeats.G, repeats.SIDE, repeats.SIDE))
    rows = []
    for left, right in ((alike, other), (alike, other[:5] + alike[5:]), (other[::-1], other), (gram + b"zz", alike)):
        rows.append(np.frombuffer(left + gram + right + bytes([repeats.SIDE, repeats.G + 2 * repeats.SIDE]), np.uint8))
    assert repeats.can_share(np.array(rows)).tolist() == [True, True, True, False]
    assert repeats.can_share(np.zeros((0, repeats.G + 2 * repeats.SIDE + 2), np.uint8)).tolist() == []
