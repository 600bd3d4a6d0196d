"""Quality by a byte-level convolutional network in numpy.

A text is cut into halves of HALF bytes; two adjacent halves make a chunk, so chunks overlap
by half and cover the whole text. WIDTH-byte filters slide over the bytes at every second
place; their rectified responses are averaged in a chunk, beside two channels that tell how
often a byte repeats the byte 1 to LAGS places before. A dense layer follows, each of its
units is max-pooled over all chunks, and a logistic unit makes one probability.

A null text counts as empty; an empty text is one chunk of padding. Scores depend on the text alone,
so repeated rows score alike. An empty table gives an empty result; columns besides the id and the text are not read. A
text is worked as a whole, in arrays some 24 times its size. Without labelled rows of both classes every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waynet.llm.common import bounded_sample, released, slices, whole_text

HALF, WIDTH, STRIDE, FILTERS, HIDDEN, LAGS = 32, 6, 2, 12, 12, 32
#: Bounds of the fit: labelled rows of each class, and epochs.
ROWS_PER_CLASS, EPOCHS = 700, 10


def _halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every text padded by zeros to whole halves (two at least), and the first half of each text."""
    sizes = np.diff(offsets)
    count = np.maximum(2, -(-(sizes + WIDTH) // HALF))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
    shift = np.repeat(first[:-1] * HALF - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, first


def _repeats(data: np.ndarray, n: int) -> np.ndarray:
    """Per half: the largest and the mean share of bytes that equal the byte p places before, p from 1 to LAGS."""
    own = data[: n * HALF]
    most, total = np.zeros(n, np.float32), np.zeros(n, np.float32)
    before = np.concatenate((np.zeros(LAGS, np.uint8), own))
    there = own != 0
    for p in range(1, LAGS + 1):
        same = ((before[LAGS - p : LAGS - p + len(own)] == own) & there).reshape(n, HALF).sum(axis=1, dtype=np.uint8) / np.float32(HALF)
        np.maximum(most, same, out=most)
        total += same
    return np.stack((most, total / LAGS), axis=1)


class ByteConvNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.filter_bias = np.zeros(FILTERS, np.float32)
        self.dense = rng.normal(0, 0.4, (FILTERS + 2, HIDDEN)).astype(np.float32)
        self.dense_bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.4, HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.filter_bias, self.dense, self.dense_bias, self.out, self.bias]

    def _responses(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = self.filters[0][data[at]]
        for o in range(1, WIDTH):
            total += self.filters[o][data[at + o]]
        total += self.filter_bias
        return np.maximum(total, 0, out=total)

    def _chunks(self, data: np.ndarray, first: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = int(first[-1])
        conv = self._responses(data, np.arange(0, n * HALF, STRIDE)).reshape(n, HALF // STRIDE, FILTERS).mean(axis=1)
        halves = np.concatenate((conv, repeats), axis=1)
        chunks = (halves[:-1] + halves[1:]) / 2
        inside = np.ones(n - 1, bool)
        inside[first[1:-1] - 1] = False  # of two texts
        hidden = np.where(inside[:, None], np.maximum(chunks @ self.dense + self.dense_bias, 0), -1)
        return chunks, hidden, np.maximum.reduceat(hidden, first[:-1], axis=0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first = _halves(data, offsets)
        pooled = self._chunks(padded, first, _repeats(padded, int(first[-1])))[2]
        return 1 / (1 + np.exp(-(pooled @ self.out + self.bias[0]).astype(float)))

    def gradients(self, padded: np.ndarray, first: np.ndarray, repeats: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss; max-pooling passes a gradient to one chunk of each text and unit alone."""
        chunks, hidden, pooled = self._chunks(padded, first, repeats)
        error = (1 / (1 + np.exp(-(pooled @ self.out + self.bias[0]))) - labels) / len(labels)
        d_pooled = error[:, None] * self.out * (pooled > 0)
        texts = np.repeat(np.arange(len(labels)), np.diff(first))[: len(hidden)]
        order = np.lexsort((-np.arange(len(hidden)),))
        d_hidden = np.zeros_like(hidden)
        for unit in range(HIDDEN):
            best = np.full(len(labels), -1)
            top = order[hidden[order, unit] >= pooled[texts[order], unit]]
            best[texts[top]] = top
            d_hidden[best, unit] = d_pooled[:, unit]
        d_chunks = d_hidden @ self.dense.T
        used = np.flatnonzero(np.abs(d_hidden).sum(axis=1) > 0)
        at = (used[:, None] * HALF + np.arange(0, 2 * HALF, STRIDE)).ravel()
        d_resp = np.repeat(d_chunks[used, :FILTERS] / (2 * HALF // STRIDE), 2 * HALF // STRIDE, axis=0) * (self._responses(padded, at) > 0)
        d_filters = np.empty_like(self.filters)
        for o in range(WIDTH):
            index = padded[at + o].astype(np.int64)[:, None] * FILTERS + np.arange(FILTERS)
            d_filters[o] = np.bincount(index.ravel(), d_resp.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return [d_filters, d_resp.sum(axis=0), chunks.T @ d_hidden, d_hidden.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 5) -> None:
        """Adam over shuffled minibatches. Classes are drawn alike, so a score is a probability where both are as common."""
        rng, moments, step = np.random.default_rng(seed), [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()], 0
        ready = []
        for group in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 48)):
            offsets = np.cumsum([0, *(len(texts[i]) for i in group)])
            padded, first = _halves(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), offsets)
            ready.append((padded, first, _repeats(padded, int(first[-1])), labels[group]))
        for _ in range(EPOCHS):
            for k in rng.permutation(len(ready)):
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self.gradients(*ready[k]), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)


def fit(labelled: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> ByteConvNet:
    """Trains on whole texts of a bounded sample of labelled rows, drawn alike from both classes."""
    rows = labelled.where(F.col(label_col).isNotNull())
    totals = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
    sample = bounded_sample(rows, label_col, id_col, ROWS_PER_CLASS, 2)
    found = sample.select(F.col(label_col).cast("double").alias("label"), F.encode(whole_text(text_col), "UTF-8").alias("text"), F.col(id_col).alias("id"))
    found = sorted(found.collect(), key=lambda r: (str(r["id"]), bytes(r["text"])))
    net = ByteConvNet()
    good, all_rows = totals.get(1, 0), sum(totals.values())
    if 0 < sum(r["label"] for r in found) < len(found):
        net.train([bytes(r["text"]) for r in found], np.array([r["label"] for r in found], np.float32))
    else:
        net.out[:] = 0
        net.bias[:] = np.log((good + 1) / (all_rows - good + 1))
    return net


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, data, offsets in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score(data, offsets))], names=["doc_id", "score"])

    return rows.mapInArrow(released(scored), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
