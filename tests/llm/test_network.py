"""The language network against a plain convolution and against differences of its loss."""

import math

import numpy as np
from plumbline.llm import langid


def plain(net, x):
    """The probabilities of one window, by loops."""
    pooled = []
    for table, w in zip(net.tables, langid.WIDTHS):
        for f in range(langid.FILTERS):
            pooled.append(max(sum(float(table[i][x[a + i]][f]) for i in range(w)) for a in range(len(x) - w + 1)))
    z = [sum(p * float(net.out[k][c]) for k, p in enumerate(pooled)) + float(net.bias[c]) for c in range(len(net.langs))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_probabilities():
    r = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"])
    net.bias[:] = r.normal(size=3)
    x = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    got = net.probabilities(x, net.pairs())
    assert np.allclose(got, [plain(net, row) for row in x], atol=1e-5) and np.allclose(got.sum(1), 1)


def test_training_goes_down_the_gradient(monkeypatch):
    """One step moves each parameter against the difference quotient of the mean loss."""
    monkeypatch.setattr(langid, "EPOCHS", 1)
    r = np.random.default_rng(2)
    x, y = r.integers(97, 103, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda n: float(-np.log(n.probabilities(x, n.pairs())[np.arange(6), y]).mean())
    net, new = langid.Network(["a", "b"]), langid.Network(["a", "b"])
    for n in (net, new):
        for name in ("tables", "out", "bias"):
            v = getattr(n, name)
            setattr(n, name, [t.astype(np.float64) for t in v] if isinstance(v, list) else v.astype(np.float64))
    new.train(x, y, rate=1e-3, batch=6)
    assert loss(new) < loss(net)
    checked = 0
    for old, moved in zip([*net.tables, net.out, net.bias], [*new.tables, new.out, new.bias]):
        step = moved - old
        for at in [tuple(a) for a in np.argwhere(step != 0)[::7]]:
            keep, h = old[at], 1e-4
            old[at] = keep + h
            up = loss(net)
            old[at] = keep - h
            down = loss(net)
            old[at] = keep
            slope = (up - down) / (2 * h)
            if abs(slope) > 1e-4:
                assert np.sign(step[at]) == -np.sign(slope)
                checked += 1
    assert checked > 30


def test_learns_bytes():
    texts = [("x" * 50 + "ab" * 30, "a"), ("y" * 50 + "cd" * 30, "c")] * 40
    net = langid.Network(["a", "c"])
    net.train(np.concatenate([langid.windows(t)[:1] for t, _ in texts]), np.array([["a", "c"].index(k) for _, k in texts]))
    p = net.probabilities(langid.windows("zz" + "ab" * 20), net.pairs())
    assert p.argmax() == 0


def test_the_sample_does_not_follow_the_layout(spark):
    """One network, however the rows lie in partitions."""
    from pyspark.sql import functions as F

    rows = [(i, f"{'der die das' if i % 2 else 'le la les'} {i} wort {i * 7}", "de" if i % 2 else "fr") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (30, 200):
        nets = [langid.fit(docs.orderBy(F.rand(k)).repartition(k), F.lit(True), sample) for k in (1, 7)]
        assert np.array_equal(nets[0].out, nets[1].out) and np.array_equal(nets[0].bias, nets[1].bias)
