"""Sets compared as sketches in a task, against plain sets."""

import numpy as np
import pytest
from plumbline.llm import minhash


@pytest.mark.parametrize("bits", [0, 32_000_000])
def test_near_pairs(monkeypatch, bits):
    monkeypatch.setattr(minhash, "BIT_BYTES", bits)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 900).astype(np.uint64)
    sets = []
    for size in [40] * 40 + [900] * 25:
        own = base[:size].copy()
        for at in r.integers(0, size, r.integers(0, size // 5)):
            own[at] = r.integers(0, 2**63)
        sets.append(np.unique(own))
    sets += [np.zeros(0, np.uint64), sets[0]]
    n, root, side = np.array([len(s) for s in sets]), r.integers(0, 12, len(sets)), r.integers(0, 2, len(sets))
    j = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b])))
    count = len(sets)

    def parts(links):
        up = list(range(count))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            up[find(a)] = find(b)
        return [find(i) for i in range(count)]

    same = [(i, int(np.flatnonzero(root == root[i])[0])) for i in range(count)]
    for sides in (side, np.zeros(count, int)):
        two = len(set(sides)) > 1
        asked = [(a, b) for a in range(count) for b in range(a + 1, count) if root[a] != root[b] and not (two and sides[a] == sides[b])]
        whole = {p: max(n[p[0]], n[p[1]]) <= minhash.LEAST for p in asked}
        near = {p: j(*p) >= 0.8 and min(n[p[0]], n[p[1]]) > 0 for p in asked}
        said = [minhash.near_pairs(n, [s[: minhash.LEAST] for s in sets], root, sides, w) for w in (False, True)]
        (sure, some), (again, every) = said
        # links: near copies alone, no more than a forest, the components of all near copies
        assert sure == again and all(near[tuple(sorted(p))] and whole[tuple(sorted(p))] for p in sure)
        linked = parts(same + sure)
        sorted_out = lambda up: sorted(tuple(i for i in range(count) if up[i] == r) for r in set(up))
        assert sorted_out(linked) == sorted_out(parts(same + [p for p in asked if near[p] and whole[p]]))
        assert len(sure) == len(set(root)) - len(set(linked))
        # doubts: none that links have joined, none missed that is a near copy, or a forest of these
        assert all(linked[a] != linked[b] and j(a, b) >= 0.6 and not whole[tuple(sorted((a, b)))] for a, b in every)
        told = {tuple(sorted(p)) for p in every}
        assert len(told) == len(every) and set(map(lambda p: tuple(sorted(p)), some)) <= told
        assert all(p in told for p in asked if near[p] and not whole[p] and linked[p[0]] != linked[p[1]])
        assert sorted_out(parts(same + sure + some)) == sorted_out(parts(same + sure + every))
        assert len(some) <= len(set(linked)) - 1


def test_sets_alike_give_a_forest():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 1200).astype(np.uint64)
    for size in (200, 1200):
        sets = [np.unique(np.append(base[: size - 3], r.integers(0, 2**63, 3).astype(np.uint64))) for _ in range(600)]
        n = np.array([len(s) for s in sets])
        for whole_doubt in (False, True)[: 2 if size == 200 else 1]:
            sure, doubt = minhash.near_pairs(n, [s[: minhash.LEAST] for s in sets], np.arange(600), np.zeros(600, int), whole_doubt)
            assert len(sure) + len(doubt) == 599
