"""Quality scores from random-indexing word vectors, pooled per document, and a two-layer network.

Every token falls into one of BUCKETS buckets; each bucket has a fixed sparse ternary index vector.
A pass over all documents adds, to every bucket, the index vectors of the tokens around it; tasks
send on sums of bounded size, whatever they read.  Documents pool the vectors of their tokens and
of their distinct tokens; a two-layer network scores them, its probabilities calibrated by one
temperature on labelled rows that it wasn't fitted on.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import crc_mod, ship, shipped, small_batches
from sectiva.llm._labels import labelled

BUCKETS = 1 << 14
DIM = 64
#: Nonzero entries of an index vector, and tokens to either side that count as context.
NONZERO, WINDOW = 4, 2
#: Buckets in one row between tasks.
BLOCK = 128
#: Labelled rows of each class that the network is fitted on at most.
TRAIN_ROWS = 4000
HIDDEN, EPOCHS, BATCH = 32, 60, 128
THRESHOLD = 0.3
#: Tokens that a worker remembers the bucket of at most.
MEMO = 500_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Buckets kept for digits and for words in capitals, which share few of them.
DIGITS, CAPITALS = 1, 64


def bucket(token: str) -> int:
    """A token's bucket: punctuation runs and words by hash, capitals and numbers in buckets of their own."""
    if token.isdigit():
        return 0
    h = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
    if len(token) > 1 and token.isupper():
        return DIGITS + h % CAPITALS
    return DIGITS + CAPITALS + h % (BUCKETS - DIGITS - CAPITALS)


class Buckets(dict):
    """Bucket by token, found once."""

    def __missing__(self, token):
        if len(self) > MEMO:
            self.clear()
        self[token] = found = bucket(token)
        return found


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's index vector."""
    rng = np.random.default_rng(42)
    return np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO], rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def token_ids(texts: list[str | None], memo: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all tokens, number of tokens of each text)."""
    found = [TOKEN.findall(t or "") for t in texts]
    n = np.array([len(x) for x in found], np.int64)
    return np.fromiter((b for x in found for b in map(memo.__getitem__, x)), np.int64, int(n.sum())), n


def add_contexts(total: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray, sign: np.ndarray):
    """Add to each token's bucket the index vectors of its neighbours in the same text."""
    owner = np.repeat(np.arange(len(n)), n)
    for gap in range(1, WINDOW + 1):
        for lo in range(0, max(len(ids) - gap, 0), 1 << 18):
            hi = min(lo + (1 << 18), len(ids) - gap)
            left, right = ids[lo:hi], ids[lo + gap : hi + gap]
            same = owner[lo:hi] == owner[lo + gap : hi + gap]
            for a, b in ((left[same], right[same]), (right[same], left[same])):
                for k in range(NONZERO):
                    total += np.bincount(a * DIM + at[b, k], sign[b, k], BUCKETS * DIM).astype(np.int64)


def _contexts(batches):
    at, sign = index_vectors()
    memo, total = Buckets(), np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        ids, n = token_ids(batch.column(0).to_pylist(), memo)
        add_contexts(total, ids, n, at, sign)
    rows = total.reshape(-1, BLOCK * DIM)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["block", "sums"])


def _sum_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(sums.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) unit vectors of all buckets, from every document; their size doesn't grow with the corpus."""
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contexts, "block bigint, sums binary")
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for r in rows.repartition(BUCKETS // BLOCK, "block").mapInArrow(_sum_blocks, "block bigint, sums binary").collect():
        total[r.block] += np.frombuffer(r.sums, np.int64)
    total = total.reshape(BUCKETS, DIM)
    unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    seen = total.any(axis=1)
    return np.where(seen[:, None], unit - (unit[seen].mean(axis=0) if seen.any() else 0), 0).astype(np.float32)


def pool(ids: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean over tokens, mean over distinct buckets, log of the length, share of distinct buckets."""
    out = np.zeros((len(n), 2 * DIM + 2))
    key, count = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + ids, return_counts=True)
    owner, b = key // BUCKETS, key % BUCKETS
    for lo in range(0, len(key), 1 << 16):
        own, v, c = owner[lo : lo + (1 << 16)], vectors[b[lo : lo + (1 << 16)]], count[lo : lo + (1 << 16), None]
        first = np.flatnonzero(np.concatenate(([True], np.diff(own) != 0)))
        out[own[first], :DIM] += np.add.reduceat(v * c, first, axis=0)
        out[own[first], DIM : 2 * DIM] += np.add.reduceat(v, first, axis=0)
    distinct = np.bincount(owner, minlength=len(n))
    out[:, :DIM] /= np.maximum(n, 1)[:, None]
    out[:, DIM : 2 * DIM] /= np.maximum(distinct, 1)[:, None]
    out[:, -2], out[:, -1] = np.log1p(n), distinct / np.maximum(n, 1)
    return out


class Network:
    """Standardised inputs, one hidden layer, a logit and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(3)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature = 1.0
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        self._fit((x[~held] - self.mean) / self.scale, y[~held], rng)
        if held.any():
            self._calibrate(self.logit(x[held]), y[held])

    def _fit(self, x, y, rng):
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                a, b = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - b) / len(b)
                back = g[:, None] * self.p[2] * (h > 0)
                grads = [a.T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ g + 1e-4 * self.p[2], g.sum(keepdims=True)]
                t += 1
                for k, d in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - 3e-3 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def logit(self, x):
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def _calibrate(self, z, y):
        """The temperature of least log loss on rows held back."""
        loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
        self.temperature = float(min(np.geomspace(0.25, 20, 200), key=loss))

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _pooled(batches, vectors):
    memo = Buckets()
    for batch in batches:
        ids, n = token_ids(batch.column(0).to_pylist(), memo)
        x = pool(ids, n, vectors)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def _scores(batches, vectors, network):
    memo = Buckets()
    for batch in batches:
        ids, n = token_ids(batch.column(1).to_pylist(), memo)
        score = network.score(pool(ids, n, vectors)) if network else np.full(len(n), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; the score is the probability of label 1.

    Learns from ``labels.quality`` of at most ``train_rows`` rows a class outside the held-out fold.
    Null and empty texts pool to zeros and are scored like any other.  Repeated rows and null ids
    are kept (a null id is not held out); null labels are ignored, and of an id labelled twice the
    higher one counts; without labels of both classes every score is 0.5.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
    rows = labelled(docs, labels, "quality", crc_mod("k", 5) != 0, train_rows, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    got = rows.select("text", "doc_id", "y").mapInArrow(lambda it: _pooled(it, vectors.value), f"doc_id {kind}, y int, x array<double>").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.x))
    y = np.array([r.y for r in got], float)
    network = ship(spark, Network(np.array([r.x for r in got]), y) if len(set(y)) == 2 else None)
    held = F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False)).alias("held_out")
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held)
    scored = scored.mapInArrow(lambda it: _scores(it, vectors.value, shipped(network)), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
