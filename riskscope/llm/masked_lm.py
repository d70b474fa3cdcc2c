"""LM scoring by masked pseudo-likelihood.

A small window network sees two words on either side of a masked position and predicts the
word. Words are hashed to a vocabulary of fixed size; the output is in two steps, a class of
about equal corpus mass from the network and the word inside its class from corpus counts.
The summed conditional log-probability of all positions scores a document.

Everything comes from the whole corpus. One pass counts all words. Each training round then
masks a share of the positions of every document by a hash of their place, every task trains
from the shared weights over all of its documents in numpy, and the weights are averaged in
Spark, weighted by examples. What is gathered grows with the tasks; what reaches the driver
is one set of counts and one set of weights, both of fixed size.

Defined cases: a null or empty text has no words and scores zero; a lone word is scored from
the padding around it; repeated rows score alike; null ids are kept; further columns are not
read; an empty table gives no rows. Scores depend in the last digits on how rows are dealt
to tasks, as sums of floats do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskscope.llm.decontaminate import Tokens
from riskscope.llm.words import mix, slices


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training; none depends on the corpus."""

    vocabulary: int = 1 << 15
    inputs: int = 1 << 11
    classes: int = 64
    side: int = 2
    width: int = 12
    hidden: int = 32
    rounds: int = 2
    masked_percent: int = 15
    batch: int = 512
    rate: float = 0.1


def _buckets(tokens: Tokens, shape: Shape) -> np.ndarray:
    return (tokens.word_hash % np.uint64(shape.vocabulary)).astype(np.int64)


def _contexts(tokens: Tokens, buckets: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Input ids of the words around each position; 0 stands for what lies outside the text."""
    text = tokens.text_of[at]
    first, last = tokens.first[text], tokens.first[text + 1]
    out = np.zeros((len(at), 2 * shape.side), np.int32)
    shifts = [s for s in range(-shape.side, shape.side + 1) if s]
    for j, s in enumerate(shifts):
        where = at + s
        inside = (where >= first) & (where < last)
        out[inside, j] = 1 + buckets[where[inside]] % (shape.inputs - 1)
    return out


class Network:
    """Embeddings, one hidden layer, class scores; all weights in one flat vector."""

    def __init__(self, shape: Shape, weights: np.ndarray | None = None):
        self.shape = shape
        d = 2 * shape.side * shape.width
        self.sizes = [(shape.inputs, shape.width), (d, shape.hidden), (shape.hidden,), (shape.hidden, shape.classes), (shape.classes,)]
        n = sum(int(np.prod(s)) for s in self.sizes)
        if weights is None:
            weights = np.random.default_rng(7).normal(0, 0.1, n).astype(np.float32)
        self.flat = np.array(weights, np.float32)
        self.parts, at = [], 0
        for s in self.sizes:
            k = int(np.prod(s))
            self.parts.append(self.flat[at : at + k].reshape(s))
            at += k

    def _forward(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, w1, b1, w2, b2 = self.parts
        x = e[contexts].reshape(len(contexts), -1)
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2
        z -= z.max(1, keepdims=True)
        return x, h, z

    def log_probability(self, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        z = self._forward(contexts)[2]
        return z[np.arange(len(z)), classes] - np.log(np.exp(z).sum(1))

    def train(self, contexts: np.ndarray, classes: np.ndarray, memory: np.ndarray) -> None:
        """One step; `memory` holds the summed squared gradients."""
        e, w1, _, w2, _ = self.parts
        x, h, z = self._forward(contexts)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), classes] -= 1
        p /= len(p)
        dh = (p @ w2.T) * (1 - h * h)
        dx = (dh @ w1.T).reshape(-1, self.shape.width)
        de = np.zeros_like(e)
        np.add.at(de, contexts.ravel(), dx)
        grad = np.concatenate([g.ravel() for g in (de, x.T @ dh, dh.sum(0), h.T @ p, p.sum(0))])
        memory += grad * grad
        self.flat -= self.shape.rate * grad / (np.sqrt(memory) + 1e-6)


def class_tables(counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(class, log P(word | class)) of each bucket: classes of about equal mass, common words first."""
    smoothed = counts + 0.5
    order = np.argsort(-smoothed, kind="stable")
    before = np.cumsum(smoothed[order]) - smoothed[order]
    classes = np.empty(len(counts), np.int64)
    classes[order] = np.minimum((before / smoothed.sum() * shape.classes).astype(np.int64), shape.classes - 1)
    mass = np.bincount(classes, smoothed, minlength=shape.classes)
    return classes, np.log(smoothed / mass[classes])


def _sent(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("string").alias("__text"))


def word_counts(docs: DataFrame, text: str, shape: Shape) -> np.ndarray:
    """How often each bucket of the vocabulary occurs in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.vocabulary, np.int64)
        for part in slices(batches, "__text"):
            total += np.bincount(_buckets(Tokens.of(part.column("__text")), shape), minlength=shape.vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(count, "bucket bigint, n bigint")
    counts = np.zeros(shape.vocabulary, np.int64)
    # One row per bucket: at most `vocabulary` rows.
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def train(docs: DataFrame, text: str, classes: np.ndarray, shape: Shape) -> np.ndarray:
    """The weights after all rounds."""
    spark = docs.sparkSession
    weights = Network(shape).flat
    for round_ in range(shape.rounds):
        shared = spark.sparkContext.broadcast((weights, classes))

        def local(batches: Iterator[pa.RecordBatch], salt=round_ + 1, shared=shared) -> Iterator[pa.RecordBatch]:
            start, classes = shared.value
            net, memory, seen = Network(shape, start), np.zeros(len(start), np.float32), 0
            for part in slices(batches, "__text"):
                tokens = Tokens.of(part.column("__text"))
                buckets = _buckets(tokens, shape)
                place = (np.arange(len(buckets)) - tokens.first[tokens.text_of]).astype(np.uint64)
                draw = mix(tokens.word_hash ^ mix(place + np.uint64(salt << 40))) % np.uint64(100)
                at = np.flatnonzero(draw < shape.masked_percent)
                contexts = _contexts(tokens, buckets, at, shape)
                target = classes[buckets[at]]
                for i in range(0, len(at), shape.batch):
                    net.train(contexts[i : i + shape.batch], target[i : i + shape.batch], memory)
                seen += len(at)
            if seen:
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n)), pa.array(net.flat.astype(float) * seen), pa.array(np.full(n, seen))], ["i", "v", "n"]
                )

        parts = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(local, "i bigint, v double, n bigint")
        # One row per weight, a number fixed by the shape.
        rows = parts.groupBy("i").agg(F.sum("v"), F.sum("n")).collect()
        if rows:
            new = np.array(weights)
            for i, v, n in rows:
                new[i] = v / n
            weights = new
        shared.destroy()
    return weights


def pseudo_likelihood(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(id, n_tokens, log_likelihood, per_token) of every row: natural logarithms, summed and per word."""
    classes, inside = class_tables(word_counts(docs, text, shape), shape)
    weights = train(docs, text, classes, shape)
    shared = docs.sparkSession.sparkContext.broadcast((weights, classes, inside))
    sent = _sent(docs, id_column, text)
    schema = sent.select(
        id_column, F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).cast("double").alias("log_likelihood")
    ).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, classes, inside = shared.value
        net = Network(shape, weights)
        for part in slices(batches, "__text"):
            tokens = Tokens.of(part.column("__text"))
            buckets = _buckets(tokens, shape)
            found = np.zeros(len(buckets))
            for i in range(0, len(buckets), 1 << 13):
                at = np.arange(i, min(i + (1 << 13), len(buckets)))
                found[at] = net.log_probability(_contexts(tokens, buckets, at, shape), classes[buckets[at]]) + inside[buckets[at]]
            total = np.bincount(tokens.text_of, found, minlength=tokens.n_texts).astype(float)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tokens.n_words.astype(np.int64)), pa.array(total)], [id_column, "n_tokens", "log_likelihood"]
            )

    return sent.mapInArrow(score, schema).withColumn(
        "per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )
