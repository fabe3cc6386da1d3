"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network in numpy.

Random indexing: every word bucket and every word shape (case, digits, the marks at its end, length) has a fixed sparse
ternary index vector drawn by hash; a word bucket's vector is the mean of its neighbours' index vectors over all
occurrences in all documents. Spark sums them in one pass into a table of BUCKETS x WIDTH numbers, whatever the input.

A document is the mean and the spread of its words' vectors, with its length, word length and repetition. A network of
one hidden layer is trained on at most max_train labelled rows chosen by hash; part of them is held back to stop the
training and to fit the temperature that calibrates its probabilities.

Defined results: null, empty and blank texts are a document of no words and are scored like any other; labels of null
are not used; repeated label rows count once; of rows that share an id with other texts one, chosen by a hash of the text, is learned
from; without labels of both kinds every score is the share of label 1 (0.5
without any); other columns are not read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_buffer
from .hashing import SPACE, word_hashes

BUCKETS, SHAPES, WIDTH, TABLES = 8192, 4096, 48, 16
_KIND = np.full(256, 4, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
_rng = np.random.default_rng(11)
_AT = _rng.integers(0, WIDTH, (BUCKETS + SHAPES, 2))
_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS + SHAPES, 2))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape and length of each word, and pointers by row."""
    raw, off = text_buffer(texts)
    words, rows, _ = word_hashes(raw, off)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none, rows
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    s = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    e = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    kind, n = _KIND[raw], e - s
    last, before = raw[e - 1].astype(np.int64), raw[np.maximum(e - 2, s)].astype(np.int64)
    mark = np.where(kind[e - 1] == 4, last, kind[e - 1])
    shape = ((kind[s] * 5 + kind[np.minimum(s + 1, e - 1)]) * 256 + mark) * 2 + ((last == before) & (n > 1))
    shape = ((shape * 9 + np.minimum(n, 24) // 3) * 2654435761 >> 7) % SHAPES
    return (words >> np.uint64(51)).astype(np.int64), shape, n, rows


def vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word-bucket vectors, from every occurrence in every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS)
        for b in batches:
            word, shape, _, rows = _tokens(b["t"])
            row = np.repeat(np.arange(b.num_rows), np.diff(rows))
            counts += np.bincount(word, minlength=BUCKETS)
            for lo in range(0, len(word), 1 << 18):
                for step, source in ((0, shape), (-1, shape), (1, shape), (-1, word), (1, word)):
                    here = np.arange(lo, min(lo + (1 << 18), len(word)))
                    here = here[(here + step >= 0) & (here + step < len(word))]
                    here = here[row[here] == row[here + step]]
                    near = source[here + step] + (BUCKETS if source is shape else 0)
                    for k in range(2):
                        sums += np.bincount(word[here] * WIDTH + _AT[near, k], _SIGN[near, k], minlength=BUCKETS * WIDTH)
        whole = np.concatenate((sums.reshape(BUCKETS, WIDTH), counts[:, None]), axis=1).astype(np.int64).reshape(TABLES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TABLES, dtype=np.int32)), pa.array([x.astype(np.int32).tobytes() for x in whole], pa.binary())], names=["k", "x"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["k"].to_pylist(), b["x"].to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "x"])

    parts = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "k int, x binary").repartition(TABLES, "k").mapInArrow(add, "k int, x binary").collect()
    whole = np.zeros((TABLES, BUCKETS // TABLES * (WIDTH + 1)))
    for r in parts:
        whole[r["k"]] = np.frombuffer(r["x"])
    whole = whole.reshape(BUCKETS, WIDTH + 1)
    return (whole[:, :-1] / np.maximum(whole[:, -1:], 1)).astype(np.float32)


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean and spread of each document's word vectors, then its scalars."""
    word, shape, n, rows = _tokens(texts)
    count = np.diff(rows)
    out = np.zeros((len(texts), 2 * WIDTH + 5), np.float32)
    for r in range(len(texts)):
        lo, hi = int(rows[r]), int(rows[r + 1])
        if lo == hi:
            continue
        bucket, times = np.unique(word[lo:hi], return_counts=True)
        w = table[bucket]
        share = (times / count[r]).astype(np.float32)
        mean = share @ w
        out[r, :WIDTH] = mean
        out[r, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(share @ (w * w) - mean * mean, 0))
        looks = np.bincount(shape[lo:hi] % 512, minlength=512) / count[r]
        out[r, 2 * WIDTH :] = (
            np.log1p(count[r]),
            len(bucket) / count[r] ** 0.8,
            float((share * share).sum()) ** 0.5,
            n[lo:hi].mean() / 10,
            float((looks * looks).sum()) ** 0.5,
        )
    return out


@dataclass
class Network:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh((x - self.mean) / self.scale @ a + b) @ c + d)[:, 0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        logit = self.logits(pooled(texts, self.table)) / self.temperature
        return np.round(1 / (1 + np.exp(-np.clip(logit, -40, 40))), 9)  # alike whatever batch a text is in


def _train(x: np.ndarray, y: np.ndarray, table: np.ndarray, hidden: int, epochs: int) -> Network:
    rng = np.random.default_rng(5)
    held = np.arange(len(y)) % 5 == 0
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    z = (x - mean) / scale
    shapes = ((x.shape[1], hidden), (hidden,), (hidden, 1), (1,))
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    net = Network(table, mean, scale, w)
    rows, best, t = np.flatnonzero(~held), (np.inf, [p.copy() for p in w]), 0

    def loss(logit: np.ndarray, target: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logit) - target * logit))

    for _ in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), 128):
            i, t = rows[lo : lo + 128], t + 1
            h = np.tanh(z[i] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip((h @ w[2] + w[3])[:, 0], -40, 40))) - y[i])[:, None] / len(i)
            back = d @ w[2].T * (1 - h * h)
            grads = (z[i].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(0))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        now = loss(net.logits(x[held]), y[held])
        if now < best[0]:
            best = now, [p.copy() for p in w]
    net.weights = best[1]
    logit = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.2, 5, 60), key=lambda c: loss(logit / c, y[held])))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 12_000, hidden: int = 24, epochs: int = 40) -> Network:
    """labels: the rows to learn from; at most max_train of them are used, chosen by hash."""
    bounded_batches(docs.sparkSession)
    table = vectors(docs, text_col)
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("i"), "i").limit(max_train))  # at most max_train rows of two numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b["t"], held.value)
            yield pa.RecordBatch.from_arrays([b["i"], b["y"], b["h"], pa.array(list(x), pa.list_(pa.float32()))], names=["i", "y", "h", "x"])

    held = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).join(sample, "i")
    # of rows that share an id the one of least text hash counts, whatever the order of tasks
    got = rows.mapInArrow(run, "i long, y int, h long, x array<float>").groupBy("i").agg(F.min_by("x", "h").alias("x"), F.min("y").alias("y")).toArrow()
    order = np.argsort(got["i"].to_numpy(), kind="stable")
    y = got["y"].to_numpy().astype(float)[order]
    if len(np.unique(y)) < 2:
        return Network(table, np.zeros(1), np.ones(1), [], prior=float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.asarray(r, np.float32) for r in got["x"].to_pylist()])[order].astype(np.float64)
    mixed = np.random.default_rng(3).permutation(len(y))
    return _train(x[mixed], y[mixed], table, hidden, epochs)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(held.value.scores(b["t"]).astype(float))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, score double")
