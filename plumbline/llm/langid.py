"""Operator 5: language identification by a byte convolutional network.

Filters of several widths over one-hot bytes (so a filter is a table of a weight for each
place and byte), max pooling over a fixed-length window, and a softmax layer; trained in
numpy on the driver from windows of a sample of at most ``SAMPLE`` labelled documents.
Prediction cuts the whole text into windows, runs them in batches, and averages the windows'
probabilities by their length.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything
when nothing is labelled; empty and short texts are padded windows; repeated rows get the
same answer; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import crc_mod

SAMPLE = 6_000
SHARES = 10**15  # steps in which a share of the labelled rows is taken; never none
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EPOCHS = 6
UND = "und"


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _conv(self, x: np.ndarray, k: int) -> np.ndarray:
        n = x.shape[1] - WIDTHS[k] + 1
        return sum(self.tables[k][i][x[:, i : i + n]] for i in range(WIDTHS[k]))

    def train(self, x: np.ndarray, y: np.ndarray, rate: float = 0.01, batch: int = 64, seed: int = 3) -> None:
        """Adam on the cross entropy; a gradient reaches a filter at its pooled place only."""
        r = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                bx, by = x[at], y[at]
                rows = np.arange(len(bx))
                best = [(c := self._conv(bx, k)).argmax(1) for k in range(len(WIDTHS))]
                pooled = np.concatenate([np.take_along_axis(self._conv(bx, k), best[k][:, None], 1)[:, 0] for k in range(len(WIDTHS))], 1)
                p = softmax(pooled @ self.out + self.bias)
                p[rows, by] -= 1
                p /= len(bx)
                up = p @ self.out.T
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[k])
                    for i in range(w):
                        np.add.at(g[i], (bx[rows[:, None], best[k] + i], np.arange(FILTERS)[None]), up[:, k * FILTERS : (k + 1) * FILTERS])
                    grads.append(g)
                t += 1
                for j, g in enumerate([*grads, pooled.T @ p, p.sum(0)]):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    params[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)

    def pairs(self) -> list:
        """Tables of two bytes at once: fewer lookups for the same sums."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return [[two(t[i], t[i + 1]) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in self.tables]

    def probabilities(self, x: np.ndarray, pairs: list) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, tables in zip(WIDTHS, pairs):
            n = x.shape[1] - w + 1
            c = None
            for i, t in enumerate(tables):
                g = t.take((two if len(t) > 256 else x)[:, 2 * i : 2 * i + n], axis=0)
                c = g if c is None else np.add(c, g, out=c)
            pooled.append(c.max(1))
        return softmax(np.concatenate(pooled, 1) @ self.out + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(text: str) -> np.ndarray:
    raw = text.encode()
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Network | None:
    """A network from at most ``sample`` labelled documents, chosen by a hash of the row."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES))
    part = labelled.filter(share < -(-SHARES * sample // n)) if n > sample else labelled
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    # in the order of a hash, so that neither the choice nor the batches follow the files' layout
    order = F.xxhash64("doc_id", "text", F.lit(2)).alias("h")
    rows = part.select("lang", F.substr("text", at, F.lit(WINDOW)).alias("w"), order).orderBy("h", "lang", "w").limit(sample).collect()
    rows = [(r["lang"], r["w"]) for r in rows if has_letter(r["w"])]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    net = Network(langs)
    x = np.concatenate([windows(w)[:1] for _, w in rows])
    net.train(x, np.array([langs.index(lang) for lang, _ in rows]))
    return net


def predict(docs: DataFrame, net: Network | None, keep: list[str], batch: int = 192) -> DataFrame:
    """``keep``, lang_pred and score for every row; kept columns of these names are replaced."""
    spark = docs.sparkSession
    said = spark.sparkContext.broadcast(net)
    source = docs.select(F.struct(*keep).alias("kept"), "text")
    schema = T.StructType([source.schema["kept"]] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = said.value
        pairs = model.pairs() if model else None
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                texts = b.column(1).to_pylist()
                ok = [i for i, t in enumerate(texts) if model and has_letter(t)]
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                if ok:
                    x = [windows(texts[i]) for i in ok]
                    size = np.array([len(texts[i].encode()) for i in ok])
                    of = np.repeat(np.arange(len(ok)), [len(w) for w in x])
                    last = np.cumsum([len(w) for w in x]) - 1
                    weight = np.full(len(of), float(WINDOW))
                    weight[last] = size - WINDOW * (np.array([len(w) for w in x]) - 1)
                    x = np.concatenate(x)
                    p = np.concatenate([model.probabilities(x[a : a + batch], pairs) for a in range(0, len(x), batch)]) * weight[:, None]
                    total = np.add.reduceat(p, np.concatenate(([0], last[:-1] + 1)), axis=0)
                    total /= total.sum(1, keepdims=True)
                    for i, q in zip(ok, total):
                        lang[i], score[i] = model.langs[int(q.argmax())], float(min(1.0, q.max()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], names=schema.names)

    names = [c for c in keep if c not in ("lang_pred", "score")]
    return source.mapInArrow(run, schema).select(*[F.col("kept")[c].alias(c) for c in names], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    net = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, net, keep or ["doc_id"])
