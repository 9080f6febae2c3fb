"""A toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (three to five bytes, its edges marked) and its vector their mean, as in
fastText; so an unseen spelling shares most of its vector with the word it disguises. A toxic passage is a few
words in a long text, so averages are taken over windows of a few words (single words do best on held-out labels),
and a document's score is the mean of its ``TOP`` worst windows. Training picks each document's worst window, then
fits embeddings and softmax together on these, again and again.

In a linear softmax over averages each n-gram adds one number to a window's logit, so after training only that
number is kept for each, and a text costs one lookup for each of its n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.labelled import remainder, sample, shares
from codeloom.llm.quality import Constant, scored
from codeloom.llm.textnum import _cuts, column_bytes, hash_words

#: The classifier is fitted on at most so many labelled documents of each label.
SAMPLE = {0: 1800, 1: 1200}
BITS, DIM, SIZES = 18, 8, (3, 4, 5)
WINDOW, STRIDE, TOP = 1, 1, 2
#: N-grams start from their odds with so many average occurrences added.
PRIOR = 3.0
THRESHOLD = 0.3
_MULTIPLY = np.random.default_rng(9).integers(1, 1 << 31, 5, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD = _FOLD * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)


def _ngrams(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size, the buckets of the n-grams of all words in order, and how many each word has.

    ``x`` is the text's bytes with white space on both sides of each word; the byte before and after a word marks
    its edges.
    """
    v = _FOLD[x]
    length = end - first
    buckets, counts = [], []
    h = v * _MULTIPLY[0]
    for j in range(1, max(SIZES)):
        h = h[:-1] + v[j:] * _MULTIPLY[j]
        if j + 1 in SIZES:
            n = np.maximum(length + 2 - j, 0)
            at = np.repeat(first - 1 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mixed = h[at]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            buckets.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
            counts.append(n)
    return buckets, counts


def _word_sums(values: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each word's mean value over its n-grams. Words are taken in blocks, so memory follows the block."""
    out = np.zeros(len(first))
    for a, b in _cuts(data, offsets):
        i, j = np.searchsorted(first, [a, b])
        if i == j:
            continue
        # edges of texts that touch need their own mark: words are laid out anew, a blank between each two
        length = end[i:j] - first[i:j]
        place = np.concatenate([[0], np.cumsum(length + 1)])
        x = np.full(place[-1] + 1, 32, np.uint8)
        word = np.repeat(np.arange(j - i), length)
        x[place[word] + 1 + _within(length)] = data[first[i:j][word] + _within(length)]
        total, number = np.zeros(j - i), np.zeros(j - i)
        for buckets, n in zip(*_ngrams(x, place[:-1] + 1, place[:-1] + 1 + length), strict=True):
            run = np.concatenate([[0.0], np.cumsum(values[buckets], dtype=np.float64)])
            stop = np.cumsum(n)
            total += run[stop] - run[stop - n]
            number += n
        out[i:j] = total / np.maximum(number, 1)
    return out


def _within(length: np.ndarray) -> np.ndarray:
    """0, 1, ... for each word."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window begins and ends among the words, and its document; a document without words has none."""
    n = np.diff(bounds)
    number = np.where(n > 0, np.maximum((n - WINDOW + STRIDE - 1) // STRIDE, 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), number)
    start = bounds[:-1][doc] + np.minimum(_within(number) * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return start, np.minimum(start + WINDOW, bounds[1:][doc]), doc


def _worst(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of each document's TOP largest window averages, and where its largest begins and ends. Missing windows and words count as 0."""
    start, end, doc = _windows(bounds)
    run = np.concatenate([[0.0], np.cumsum(words)])
    value = (run[end] - run[start]) / WINDOW
    top = np.zeros(len(bounds) - 1)
    where = np.zeros((2, len(bounds) - 1), np.int64)
    if len(doc):
        order = np.lexsort((value, doc))
        last = order[np.flatnonzero(np.concatenate([doc[order][1:] != doc[order][:-1], [True]]))]
        place = np.searchsorted(doc[order], np.arange(len(bounds) - 1), "right")
        few = np.minimum(np.bincount(doc, minlength=len(bounds) - 1), TOP)
        ranked = np.concatenate([[0.0], np.cumsum(value[order])])
        top = (ranked[place] - ranked[place - few]) / TOP
        where[0, doc[last]], where[1, doc[last]] = start[last], end[last]
    return top, where[0], where[1]


class ToxicityModel:
    """One number for each n-gram bucket and the scale of the logit."""

    def fit(self, texts: list[str], labels: list[int], share: float, seed: int = 4) -> ToxicityModel:
        y = np.array(labels)
        data, offsets = column_bytes(pa.array(texts, pa.string()))
        numbers, bounds, first, end = hash_words(data, offsets, ends_too=True)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        _, sample_at, which = np.unique(numbers, return_index=True, return_inverse=True)
        spelled = [bytes(data[first[i] : end[i]]) for i in sample_at]
        x = np.frombuffer(b" " + b" ".join(spelled) + b" ", np.uint8)
        length = end[sample_at] - first[sample_at]
        begin = 1 + np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        each, n = _ngrams(x, begin, begin + length)
        count = sum(n)  # a word's n-grams of all sizes, side by side
        bound = np.concatenate([[0], np.cumsum(count)])
        number = np.maximum(count, 1)
        flat, filled = np.zeros(bound[-1], np.int32), bound[:-1].copy()
        for grams, k in zip(each, n, strict=True):
            flat[np.repeat(filled, k) + _within(k)] = grams
            filled += k
        del each, grams, x, spelled
        # start from how much more often the n-gram stands in toxic documents than in others
        seen = [np.bincount(which[y[doc] == c], minlength=len(length)).astype(float) for c in (0, 1)]
        times = [np.bincount(flat, weights=np.repeat(s, np.diff(bound)), minlength=1 << BITS) for s in seen]
        part = times[1].sum() / max(times[0].sum() + times[1].sum(), 1)
        ratio = np.log((times[1] + PRIOR * part) / (times[0] + PRIOR * (1 - part))) - np.log(part / (1 - part))
        rng = np.random.default_rng(seed)
        out = rng.normal(0, 1, DIM)
        out /= np.linalg.norm(out)
        table = (ratio[:, None] * out + rng.normal(0, 0.01, (1 << BITS, DIM))).astype(np.float32)
        scale = np.float64(4.0)
        soft = np.stack([-out / 2, out / 2], axis=1) * scale
        bias = np.zeros(2)
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        train = rng.random(len(y)) < 0.8
        moment = np.zeros(1 << BITS), np.zeros((DIM, 2)), np.zeros(2)
        for _ in range(6):
            value = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
            per_word = np.add.reduceat(np.append(value[flat], 0.0), np.minimum(bound[:-1], len(flat))) * (np.diff(bound) > 0) / number
            _, start, stop = _worst(per_word[which], bounds)
            rows = np.flatnonzero(train & (stop > start))
            size = (stop - start)[rows]
            at = np.repeat(start[rows], size) + _within(size)
            used, local = np.unique(which[at], return_inverse=True)
            grams = np.concatenate([flat[bound[w] : bound[w + 1]] for w in used])
            span = (bound[1:] - bound[:-1])[used]
            edge = np.concatenate([[0], np.cumsum(span)])
            row_of = np.repeat(np.arange(len(rows)), size)
            for _ in range(12):
                vec = np.add.reduceat(table[grams], np.minimum(edge[:-1], len(grams) - 1), axis=0) / number[used][:, None]
                bag = np.zeros((len(rows), DIM))
                np.add.at(bag, row_of, vec[local])
                bag /= WINDOW
                z = bag @ soft + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                g = p.copy()
                g[np.arange(len(rows)), y[rows]] -= 1
                g *= weight[rows][:, None] / len(rows)
                down = (g @ soft.T) / WINDOW
                to_word = np.zeros((len(used), DIM))
                np.add.at(to_word, local, down[row_of])
                to_word /= number[used][:, None]
                to_gram = np.zeros((1 << BITS, DIM), np.float32)
                np.add.at(to_gram, grams, np.repeat(to_word, span, axis=0))
                to_soft, to_bias = bag.T @ g + 1e-5 * soft, g.sum(axis=0)
                square = (to_gram**2).mean(axis=1)
                moment[0][:] += square  # Adagrad, one step size a bucket
                table -= (0.3 * to_gram / (np.sqrt(moment[0])[:, None] + 1e-7) * (square > 0)[:, None]).astype(np.float32)
                moment[1][:] += to_soft**2
                soft -= 0.1 * to_soft / (np.sqrt(moment[1]) + 1e-8)
                moment[2][:] += to_bias**2
                bias -= 0.1 * to_bias / (np.sqrt(moment[2]) + 1e-8)
        self.values = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        value = self.values.astype(np.float64)
        per_word = np.add.reduceat(np.append(value[flat], 0.0), np.minimum(bound[:-1], len(flat))) * (np.diff(bound) > 0) / number
        best, _, _ = _worst(per_word[which], bounds)
        held = ~train if 20 <= (~train).sum() and len(set(y[~train])) == 2 else np.ones(len(y), bool)
        self._calibrate(best[held], y[held], share)
        return self

    def _calibrate(self, s: np.ndarray, y: np.ndarray, share: float) -> None:
        """Slope and offset of the logit, each label weighted to its share among all labelled documents."""
        w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
        centre, spread = s.mean(), s.std() + 1e-9
        a, b = 1.0, 0.0
        t = (s - centre) / spread
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * t + b, -30, 30)))
            g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-6)
            grad = np.array([(g * t).sum() + 0.05 * a, g.sum()])
            hess = np.array([[(h * t * t).sum() + 0.05, (h * t).sum()], [(h * t).sum(), h.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.offset = a / spread, b - a * centre / spread

    def score(self, col: pa.Array) -> np.ndarray:
        data, offsets = column_bytes(col)
        _, bounds, first, end = hash_words(data, offsets, ends_too=True)
        best, _, _ = _worst(_word_sums(self.values, data, first, end, offsets), bounds)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None):
    """A model from a bounded sample of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), held-out fold excepted."""
    rows = sample(docs, labels, "toxic", bounds or SAMPLE, 4, 2)
    rows.sort()  # rows come in any order, the model shall not depend on it
    share = shares(labels, "toxic", 4, 2).get(1, 0.0)
    if len({y for _, y in rows}) < 2:
        return Constant(share if rows else 0.5)
    return ToxicityModel().fit([t for t, _ in rows], [y for _, y in rows], share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability that toxic is 1), predicted (score >= 0.3).

    held_out is that crc32 of the id as text modulo 4 is 2; such labels are never used. The fit takes at most
    ``bounds`` documents of each label. Null and empty texts get the score of a window without words. A null id
    has held_out null. Without labels of both values all scores are one constant. Further columns are not read.
    """
    out = scored(docs, fit_toxicity(docs, labels, bounds), THRESHOLD)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
