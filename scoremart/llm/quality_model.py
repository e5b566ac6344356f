"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token bucket has a sparse ternary index vector.  A bucket's context vector is the sum of the index vectors of its
neighbours over all documents; tasks add theirs up in whole numbers and send one partial sum per chunk of buckets, so
the result does not depend on order.  A document is the mean of its tokens' centred unit vectors.  A network with one
hidden layer is trained on a bounded sample of labelled rows (``TRAIN_ROWS``, the least by a hash of the id), and its
outputs are divided by a temperature fitted on rows that training did not see.

Null and empty texts have the zero vector and are scored like any other; repeated rows get equal scores; without labelled
rows every score is 0.5; an empty table gives an empty result; only id and text of a document and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, pieces, stage
from .words import LETTERS_AND_MARKS, mix, split_runs, word_hashes

BUCKETS = 1 << 15
DIM = 64
CHUNK = 512
#: Neighbours on each side, and non-zero entries of an index vector.
REACH, ENTRIES = 2, 2
#: Bound on the labelled rows that are fetched for training.
TRAIN_ROWS = 40_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 24, 256, 3e-3, 1e-4
HELD_FOLDS = 5


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's non-zero entries, from a hash."""
    h = mix(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BUCKETS, ENTRIES)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def token_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each token: runs of letters and digits, and runs of other visible characters."""
    starts, ends, row = split_runs(data, bounds, LETTERS_AND_MARKS)
    return (word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), row


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all documents; ``BUCKETS`` x ``DIM`` whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                token, row = token_buckets(data, bounds)
                for d in range(1, REACH + 1):
                    same = row[d:] == row[:-d]
                    a, b = token[:-d][same], token[d:][same]
                    for k in range(ENTRIES):
                        flat = np.concatenate([a * DIM + place[b, k], b * DIM + place[a, k]])
                        total += np.bincount(flat, np.concatenate([sign[b, k], sign[a, k]]), len(total)).astype(np.int64)
        yield chunks(total)

    def chunks(total: np.ndarray) -> pa.RecordBatch:
        parts = total.reshape(-1, CHUNK * DIM)
        at = np.flatnonzero(parts.any(axis=1))
        values = pa.array([parts[i].astype("<i8").tobytes() for i in at], pa.binary())
        return pa.record_batch([pa.array(at, pa.int32()), values], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM, np.int64).reshape(-1, CHUNK * DIM)
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] += np.frombuffer(raw, "<i8")
        yield chunks(total.reshape(-1))

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, "chunk int, sums binary")
    out = np.zeros((BUCKETS // CHUNK, CHUNK * DIM), np.int64)
    for r in partial.repartition("chunk").mapInArrow(add, "chunk int, sums binary").collect():  # BUCKETS x DIM numbers
        out[r["chunk"]] += np.frombuffer(r["sums"], "<i8")
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, without the direction that all buckets share."""

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    vectors = unit(sums.astype(np.float64))
    used = sums.any(axis=1, keepdims=True)
    centre = vectors.sum(axis=0) / max(1, int(used.sum()))
    return (unit(vectors - centre) * used).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, vector``: mean token vector, its length, and the logarithm of the token count (little-endian floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in pieces(batch.column(1), 1 << 19):
                token, row = token_buckets(data, bounds)
                n = np.bincount(row, minlength=high - low)
                sums = np.zeros((high - low, DIM), np.float32)
                full = np.flatnonzero(n)
                if len(full):
                    sums[full] = np.add.reduceat(vectors[token], (np.cumsum(n) - n)[full])
                mean = sums / np.maximum(n, 1)[:, None]
                size = np.linalg.norm(mean, axis=1)
                out = np.column_stack([mean * 4, size * 4, np.log1p(n)]).astype("<f4")
                ids = batch.column(0).slice(low, high - low)
                yield pa.record_batch([ids, pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "vector"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, vector binary"
    )


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
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant_network(width: int, probability: float) -> Network:
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the cross entropy; the last sixth of the rows only sets the temperature."""
    width = x.shape[1] if x.ndim == 2 else DIM + 2
    if not len(y) or y.min() == y.max():
        return constant_network(width, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    cut = len(y) - len(y) // 6
    own, label = x[:cut].astype(np.float64), y[:cut].astype(np.float64)
    net = Network(own.mean(axis=0), own.std(axis=0) + 1e-6, rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    z = (own - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(cut)
        rate = RATE * (1 - epoch / EPOCHS)
        for low in range(0, cut, BATCH):
            at = order[low : low + BATCH]
            a = z[at]
            hidden = np.maximum(a @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
            g = (p - label[at]) / len(at)
            back = np.outer(g, params[2]) * (hidden > 0)
            grads = [a.T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ g + DECAY * params[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    rest, truth = (net.logits(x[cut:]), y[cut:]) if len(y) > cut else (net.logits(x), y)

    def loss(t: float) -> float:
        v = rest / t
        return float(np.mean(np.logaddexp(0, v) - truth * v))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def fold(doc_id: str) -> Column:
    """CRC-32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_FOLDS


def training_rows(vectors: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """At most ``TRAIN_ROWS`` labelled vectors outside the held-out fold, one per id."""
    one = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("y"))
    rows = vectors.where(fold("doc_id") != 0).join(one, F.col("doc_id") == F.col("id"))
    rows = rows.select("doc_id", "vector", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(TRAIN_ROWS).toPandas()
    x = np.frombuffer(b"".join(rows["vector"]), "<f4").reshape(len(rows), DIM + 2)
    return x, rows["y"].to_numpy(np.float64)


def score(vectors: DataFrame, network: Network) -> DataFrame:
    """``doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, DIM + 2)
            yield pa.record_batch([batch.column(0), pa.array(network.scores(x), pa.float64())], ["doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "vector").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` of every document; a null id has no fold: it is not held out, nor learnt from."""
    vectors = stage(pooled(docs, word_vectors(context_sums(docs))), "quality-vectors")
    network = train(*training_rows(vectors, labels, label))
    held = fresh_name(vectors, "fold")
    out = score(vectors, network).withColumn(held, fold("doc_id"))
    return out.select("doc_id", F.coalesce(F.col(held) == 0, F.lit(False)).alias("held_out"), "score")
