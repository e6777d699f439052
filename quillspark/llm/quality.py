"""Quality classifier: supervised subword embeddings.

Every word and every character 3-gram and 4-gram within a word has a hashed bucket with a
learned vector; so has the word pair "the same word again".  A document is the average of
the vectors of all these features; a softmax over it gives the labels.  Vectors and output weights are trained together by
stochastic gradient descent in numpy.

For reading, output weights fold into the vectors: one number per bucket, summed over a
document and divided by its number of features.

Defined results: a null or blank text has no features and gets the score of the bias;
texts of any length are read whole; repeated rows give repeated results; without labelled
rows of both kinds every score is that of the one label seen, or 0.5; further columns are
not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.buffers import SPACE, small_batches, span_hash, texts, tidy, words
from quillspark.llm.toxicity import labelled_sample

#: Bounds: labelled documents it is trained on, bits of the bucket table, size of a vector.
SAMPLE, BITS, DIMS = 3000, 16, 8
EPOCHS, RATE, BATCH = 8, 1.0, 16
GRAMS = (3, 4)
#: The bucket of a word that repeats the one before it; the table is one row longer for it.
AGAIN = 1 << BITS
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and n-gram of every row; n-grams lie within words of one row."""
    shift = np.uint64(64 - BITS)
    start, end, row = words(data, at)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    word = span_hash(data, start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    buckets, rows = [(word >> shift).astype(np.int32), np.full(len(again), AGAIN, np.int32)], [row, row[again]]
    # characters: where they begin, and their bytes as one number
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    wide = data[first].astype(np.uint64)
    for j, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        longer = data[first] >= least
        wide[longer] |= data[first[longer] + j].astype(np.uint64) << np.uint64(8 * j)
    wide += np.uint64(1)
    number = np.cumsum(lead) - 1
    start, size = number[start], number[end - 1] - number[start] + 1
    word_of = np.repeat(np.arange(len(start)), size)
    within = np.arange(len(word_of)) - np.repeat(np.cumsum(size) - size, size)
    place, left = np.repeat(start, size) + within, np.repeat(size, size) - within
    for n in GRAMS:
        own = place[left >= n]
        h = np.zeros(len(own), np.uint64)
        for j in range(n):
            h = (h + wide[own + j]) * _SPREAD[(n + j) % 4]
            h ^= h >> np.uint64(31)
        buckets.append((h * _SPREAD[0] >> shift).astype(np.int32))
        rows.append(row[word_of[left >= n]])
    return np.concatenate(buckets), np.concatenate(rows)


class Model:
    """Bucket vectors, output weights and bias; label 1 against label 0."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    rng = np.random.default_rng(2)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, ((1 << BITS) + 1, DIMS)).astype(np.float32)
    output, bias = np.zeros((DIMS, 2)), np.zeros(2)
    y = np.array([t for _, t in rows], int)
    if len(set(y.tolist())) < 2:
        p = float(y[0]) if len(y) else 0.5
        return Model(vectors, output, np.log(np.array([1 - p + 1e-4, p + 1e-4])))
    bags = []
    for text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        b, _ = features(raw, np.array([0, len(raw)]))
        ids, n = np.unique(b, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    steps = 0
    total = epochs * len(rows)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            step = rate * (1 - steps / total)
            steps += len(pick)
            ids = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            got = vectors[ids]
            first = np.searchsorted(of, np.arange(len(pick)))
            full = np.array([len(bags[i][0]) > 0 for i in pick])
            hidden = np.zeros((len(pick), DIMS))
            if len(ids):
                hidden[full] = np.add.reduceat(got * share[:, None], first[full], axis=0)
            err = _softmax(hidden @ output + bias)
            err[np.arange(len(pick)), y[pick]] -= 1
            back = (err @ output.T).astype(np.float32)
            output -= step * hidden.T @ err / len(pick) * 4
            bias -= step * err.mean(0)
            np.add.at(vectors, ids, -np.float32(step * 4) * share[:, None] * back[of])
    return Model(vectors, output, bias)


@tidy
def _scored(batches, table: np.ndarray, bias: float, threshold: float):
    for b in batches:
        for lo, hi, data, at in texts(b.column("text"), 1 << 18):
            bucket, row = features(data, at)
            n = np.bincount(row, minlength=hi - lo)
            logit = np.bincount(row, table[bucket], hi - lo) / np.maximum(1, n) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            ids = b.column("doc_id").slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """-> doc_id, held_out, score, predicted for every whole text."""
    table, bias = model.folded()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = small_batches(src).mapInArrow(partial(_scored, table=table, bias=bias, threshold=threshold), "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    return score(docs, train(labelled_sample(docs, labels, "quality", sample)), threshold)


@tidy
def _passed(batches, table: np.ndarray, bias: float, threshold: float):
    for b in batches:
        keep = []
        for lo, hi, data, at in texts(b.column("text"), 1 << 18):
            bucket, row = features(data, at)
            n = np.bincount(row, minlength=hi - lo)
            logit = np.bincount(row, table[bucket], hi - lo) / np.maximum(1, n) + bias
            keep.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))) >= threshold)
        if keep:
            yield b.filter(pa.array(np.concatenate(keep)))


def passing(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that the model accepts."""
    table, bias = model.folded()
    return small_batches(docs).mapInArrow(partial(_passed, table=table, bias=bias, threshold=threshold), docs.schema)


__all__ = ["SPACE", "Model", "features", "passing", "quality", "score", "train"]
