"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Random indexing (Kanerva et al., 2000; Sahlgren, 2005): every word has a sparse ternary index vector; a word's
vector is the sum of its neighbours' index vectors, turned by their distance, and its own. A document is the mean of
its words' vectors with three counts beside it. Words too rare for a vector of their own share one by their shape
(kinds of characters and length), which is what tells shouting, lists and markup.

The network is fitted on a bounded sample and its logits are divided by a temperature fitted on a part of the
sample that it hasn't seen, in both each label weighted to its share among all labelled documents. Every document is scored by its whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.labelled import remainder, sample, shares
from codeloom.llm.textnum import U, column_bytes, give_back, hash_words, mix

#: The classifier is fitted on at most so many labelled documents of each label.
SAMPLE = {0: 1200, 1: 1800}
DIM, ONES, NEAR, LEAST_COUNT, MOST_WORDS, HIDDEN = 96, 6, 2, 8, 20_000, 24
THRESHOLD = 0.3
_KIND = np.zeros(256, np.uint8)
for _bit, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b"!?", b".,;:", b"|<>{}[]=_*#/\\@&%$^~`+", range(128, 256))):
    _KIND[list(_members)] |= 1 << _bit
SHAPES = 128 * 4


def index_vectors(numbers: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of words by their numbers: ONES places, signs by the next bit."""
    out = np.zeros((len(numbers), DIM), np.float32)
    rows = np.arange(len(numbers))
    for j in range(ONES):
        h = mix(numbers + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[rows, ((h >> U(8)) % U(DIM)).astype(np.int64)] += np.where(h & U(1), 1, -1).astype(np.float32)
    return out


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its number, shape and length, and the bounds of each row's words."""
    data, offsets = column_bytes(col)
    numbers, bounds, first, end = hash_words(data, offsets, fold=False, ends_too=True)
    if not len(numbers):
        return numbers, np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    kinds = np.bitwise_or.reduceat(_KIND[data], first).astype(np.int64)  # white space between has no kind
    length = end - first
    return numbers, kinds * 4 + np.searchsorted([4, 9, 16], length, "right"), length, bounds


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class QualityModel:
    """Word vectors, network and temperature. ``fit`` makes one from texts and labels; ``score`` gives probabilities."""

    def fit(self, texts: list[str], labels: list[int], share: float | None = None, seed: int = 3) -> QualityModel:
        """``share``: that of label 1 among all labelled documents, if not as in ``labels``."""
        blocks = [texts[i : i + 100] for i in range(0, len(texts), 100)]  # memory follows the block and the vocabulary
        words = lambda block: words_of(pa.array(block, pa.string()))
        known, count = np.unique(np.concatenate([words(b)[0] for b in blocks]), return_counts=True)
        known = known[count >= LEAST_COUNT] if (count >= LEAST_COUNT).sum() <= MOST_WORDS else np.sort(known[np.argsort(-count, kind="stable")[:MOST_WORDS]])
        self.known = known
        index = index_vectors(np.concatenate([np.arange(SHAPES, dtype=np.uint64), known]))
        context = np.zeros_like(index)
        for numbers, shapes, _, bounds in map(words, blocks):
            self._learn(context, index, self._rows(numbers, shapes), np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds)))
        self.vectors = (_unit(context) + _unit(index)).astype(np.float32)
        del index, context
        x = np.concatenate([self._pool(*words(b)) for b in blocks])
        y = np.array(labels, np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        one = y.mean()
        w = np.ones(len(y)) if share is None else np.where(y > 0, share / max(one, 1e-9), (1 - share) / max(1 - one, 1e-9))
        self._train(x[used], y[used], w[used], rng)
        z = self._logit(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [(w[held] * np.logaddexp(0, -np.where(y[held] > 0, z, -z) / t)).mean() for t in grid] if len(held) else [0.0]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(held) else 1.0
        return self

    def _learn(self, context: np.ndarray, index: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> None:
        """Adds to each word's context the index vectors of its neighbours in its document, turned by their distance."""
        for step in range(1, NEAR + 1):
            same = doc[step:] == doc[:-step]
            for at, by, turn in ((rows[:-step][same], rows[step:][same], step), (rows[step:][same], rows[:-step][same], -step)):
                pairs, times = np.unique(at * len(index) + by, return_counts=True)
                turned = np.roll(index, turn, axis=1)
                for i in range(0, len(pairs), 1 << 14):
                    part = pairs[i : i + (1 << 14)]
                    w = part // len(index)
                    heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    context[w[heads]] += np.add.reduceat(turned[part % len(index)] * times[i : i + (1 << 14), None].astype(np.float32), heads, axis=0)

    def _rows(self, numbers: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Each word's row in the vectors: by itself if it is known, else by its shape."""
        if not len(self.known):
            return shapes
        at = np.searchsorted(self.known, numbers)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == numbers, at + SHAPES, shapes)

    def _pool(self, numbers: np.ndarray, shapes: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        out = np.zeros((len(n), DIM + 3))
        rows = self._rows(numbers, shapes)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                for c in range(a, b, 1 << 15):
                    out[i, :DIM] += self.vectors[rows[c : min(b, c + (1 << 15))]].sum(axis=0)
                out[i, :DIM] /= b - a
                out[i, DIM:] = len(np.unique(numbers[a:b])) / (b - a), np.log(b - a), length[a:b].mean()
        return out

    def _train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int = 60, batch: int = 64) -> None:
        shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
        p = [rng.normal(0, 1 / np.sqrt(shape[0][0]), shape[0]), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                h = np.tanh(x[b] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[b]) * weight[b] / len(b)
                gh = g[:, None] * p[2] * (1 - h * h)
                grads = [x[b].T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for k, d in enumerate(grads):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.layers = p

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def score(self, col: pa.Array) -> np.ndarray:
        x = (self._pool(*words_of(col)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) by a model that every task gets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                p = sent.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


class Constant:
    """A model for lack of labels: one probability for all texts."""

    def __init__(self, p: float):
        self.p = p

    def score(self, col: pa.Array) -> np.ndarray:
        return np.full(len(col), self.p)


def fit_quality(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None):
    """A model from a bounded sample of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), held-out fold excepted."""
    rows = sample(docs, labels, "quality", bounds or SAMPLE, 5, 0)
    rows.sort()  # rows come in any order, the model shall not depend on it
    if len({y for _, y in rows}) < 2:
        return Constant(rows[0][1] * 0.98 + 0.01 if rows else 0.5)
    model = QualityModel().fit([t for t, _ in rows], [y for _, y in rows], shares(labels, "quality", 5, 0)[1])
    del rows
    give_back()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability that quality is 1), predicted (score >= 0.3).

    held_out is that crc32 of the id as text is a multiple of 5; such labels are never used. The fit takes at most
    ``bounds`` documents of each label. Null and empty texts get the score of a text without words. A null id has
    held_out null. Without labels of both values all scores are one constant. Further columns are not read.
    """
    out = scored(docs, fit_quality(docs, labels, bounds), THRESHOLD)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; every row is judged by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(sent.value.score(part.column(at)) >= THRESHOLD))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
