"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word gives two units: its lower-cased spelling and its shape (the steps between upper case,
other letters, digits and symbols; a word equal to the one before has a shape of its own). Units
fall into a fixed number of rows. A row's vector is the sum of the sparse random index vectors of
the units around its occurrences in all documents, made unit length. A document is described by
the mean of its units' vectors, and by the least and greatest means over its blocks of words.
A two-layer numpy network is fitted to a bounded sample of labelled rows, and its probabilities
are calibrated by one temperature on rows set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import Words, buffers, constants, map_rows, mix, slices, small_batches, tidy

ROWS, DIMS, NONZERO, REACH = 1 << 14, 32, 2, 2
BLOCK = 48
#: Blocks of partial sums that one task adds.
FAN_IN = 64
WIDTH = 6 * DIMS + 1


def _classes() -> np.ndarray:
    c = np.arange(256)
    c[65:91], c[97:123], c[128:], c[48:58] = 1, 2, 2, 3
    return c


_CLASS = _classes()


def units(w: Words) -> np.ndarray:
    """Rows of the units of all words, (words, 2): shape and spelling."""
    n = len(w.start)
    out = np.zeros((n, 2), np.int64)
    if not n:
        return out
    spelling = w.hashes(lower=True)
    kind = _CLASS[w.data]
    before = np.zeros(len(kind), np.int64)
    before[1:] = kind[:-1]
    before[w.start] = 0
    steps = np.where(before != kind, constants(1 << 16, 31)[before << 8 | kind], np.uint64(0))
    total = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(steps, out=total[1:])
    shape = total[w.end] - total[w.start]
    exact = w.hashes()
    same = np.zeros(n, bool)
    same[1:] = exact[1:] == exact[:-1]
    same[w.first[:-1][w.first[:-1] < n]] = False
    shape = mix(shape + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[:, 0] = shape % np.uint64(ROWS // 4)
    out[:, 1] = ROWS // 4 + (spelling % np.uint64(ROWS - ROWS // 4)).astype(np.int64)
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    h = mix(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED270B)).reshape(ROWS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Row vectors from the contexts of all words of all documents. A fixed size for any input."""
    places, signs = index_vectors()

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIMS)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for x, y in slices(offsets):
                w = Words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                rows = units(w).reshape(-1)
                doc = np.repeat(np.arange(y - x), 2 * np.diff(w.first))
                for d in range(1, REACH + 1):
                    on = np.flatnonzero(doc[d:] == doc[:-d])
                    a, b = rows[on], rows[on + d]
                    for k in range(NONZERO):
                        total += np.bincount(np.concatenate([a * DIMS + places[b, k], b * DIMS + places[a, k]]), np.concatenate([signs[b, k], signs[a, k]]), ROWS * DIMS)
        for part, values in enumerate(np.split(total.astype("<f8"), 64)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "<f8") for b in table.column("sums"))
        return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums, left = text.mapInArrow(count, "part int, sums binary").withColumn("salt", F.spark_partition_id()), text.rdd.getNumPartitions()
    # a task adds FAN_IN blocks, however many tasks there were
    while left > 1:
        left = -(-left // FAN_IN)
        sums = sums.withColumn("salt", F.col("salt") % left).groupBy("part", "salt").applyInArrow(add, "part int, salt int, sums binary")
    # 64 rows of fixed size reach the driver
    parts = {r["part"]: r["sums"] for r in sums.collect()}
    if not parts:
        return np.zeros((ROWS, DIMS), np.float32)
    vectors = np.concatenate([np.frombuffer(parts[k], "<f8") for k in range(64)]).reshape(ROWS, DIMS)
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(documents, WIDTH): mean, least and greatest block means of both units, and log length."""
    w = Words(data, offsets)
    n = np.diff(w.first)
    out = np.zeros((len(n), WIDTH), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    rows = units(w)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - np.repeat(w.first[:-1], n)
    # a short last block joins the one before
    block = np.minimum(place // BLOCK, np.maximum(1, n // BLOCK)[doc] - 1)
    starts = np.flatnonzero(np.diff(doc << 32 | block, prepend=-1))
    sizes = np.diff(np.append(starts, len(doc)))[:, None]
    first = np.searchsorted(doc[starts], full)
    for k in range(2):
        sums = np.add.reduceat(vectors[rows[:, k]], starts, axis=0)
        means = sums / sizes
        at = 3 * k * DIMS
        out[full, at : at + DIMS] = np.add.reduceat(sums, first, axis=0) / n[full, None]
        out[full, at + DIMS : at + 2 * DIMS] = np.minimum.reduceat(means, first, axis=0)
        out[full, at + 2 * DIMS : at + 3 * DIMS] = np.maximum.reduceat(means, first, axis=0)
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the log loss; a tenth of the rows is set aside for the temperature."""
    rng = np.random.default_rng(seed)
    if len(x) == 0:
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 0.0)
    order = rng.permutation(len(x))
    aside = order[: len(x) // 10]
    used = order[len(x) // 10 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-4
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), float(np.log((y[used].sum() + 1) / (len(used) - y[used].sum() + 1))))
    z = ((x - mean) / scale).astype(np.float64)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    for epoch in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), 256):
            at = used[k : k + 256]
            h = np.tanh(z[at] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -500, 500)))
            g = (p - y[at]) / len(at)
            back = np.outer(g, weights[2]) * (1 - h * h)
            grads = [z[at].T @ back + decay * weights[0], back.sum(axis=0), h.T @ g + decay * weights[2], np.array([g.sum()])]
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                weights[i] -= now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    if len(aside):
        logits = net.logits(x[aside])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        loss = [np.logaddexp(0, np.where(y[aside] > 0, -logits, logits) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(column: str = "doc_id"):
    """crc32 of the id as text is a multiple of 5; a null id is held out, too."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network fitted to at most `most` labelled rows that aren't held out.

    The sample is taken by hash of doc_id. Of rows that share a doc_id the labels' least counts, and
    the text with the least hash; null labels don't. Without labelled rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    @tidy
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for x, y in slices(offsets):
                rows = features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], batch.column(1)[x:y], pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # `most` bounds the sample
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("doc_id", "quality", "text")
    found = sorted((r["doc_id"], r["features"], r["quality"]) for r in joined.mapInArrow(describe, "doc_id long, quality double, features binary").collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in found]).reshape(-1, WIDTH)
    return vectors, fit(x, np.array([r[2] for r in found]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, by whole texts; null texts are empty."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for x, y in slices(offsets):
                p = net.probabilities(features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], batch.column(1)[x:y], pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, vectors: np.ndarray, net: Network, cut: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose score reaches the cut."""
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            p = [net.probabilities(features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], vectors)) for x, y in slices(offsets)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *p]) >= cut))

    return map_rows(docs, run, docs.columns)


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, cut: float = 0.3) -> DataFrame:
    """Score of every row; only labels of rows that aren't held out are learned from. Other columns are ignored."""
    return score(docs, *train(docs, labels, most), cut)
