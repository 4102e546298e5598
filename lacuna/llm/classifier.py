"""Quality scores from random-indexing word vectors and a two-layer network with a calibrated temperature.

Every token (a run of letters, of digits or of marks) falls into one of ``BUCKETS`` hash buckets, and each bucket has a
sparse random index vector.  A bucket's word vector is the sum of the index vectors of its neighbours within ``REACH``
tokens, over all documents: integer counts, summed by Spark, so the vectors do not depend on the order of work.  A
document is the mean and the spread of its tokens' unit vectors.  A small numpy network learns the labels on these
features from at most about ``FIT_ROWS`` labelled rows outside the held-out fold; another part of the labelled rows sets
the temperature that divides its logits.

The vectors (``BUCKETS * WIDTH`` numbers) and the network are all that is sent to the tasks.  Labels, language, source
and id are never inputs of a score.

Defined results: null or empty text has zero features and still gets a score; labels without a row are ignored, of
contradicting labels of one id the lowest counts, labels other than 0 and 1 are left out; with one class only (or none)
the score is its smoothed share of 1; a null id counts in the fold of the text ``null``; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fresh, learns
from .session import ship, stored
from .text import mix, prefix_sums, slices, span_hash

BUCKETS = 4096
WIDTH = 64
NONZERO = 4
REACH = 2
FIT_ROWS = 20_000
HIDDEN = 32
CUT = 0.3
SLICE = 1 << 20

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 white space, 1 letter, 2 digit, 3 mark
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:] = 1
_KIND[48:58] = 2


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ``NONZERO`` entries of each bucket's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token and each row's first token (one more entry than rows)."""
    kind = _KIND[data]
    turn = np.ones(len(data), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    edges = offsets[offsets < len(data)]
    turn[edges] = True
    at = np.flatnonzero(turn)
    ends = np.r_[at[1:], len(data)]
    live = kind[at] != 0
    at, ends = at[live], ends[live]
    return (span_hash(prefix_sums(data), at, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(at, offsets)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket, for one task."""
    place, sign = _index()
    total = np.zeros(BUCKETS * WIDTH)
    for batch in batches:
        for _, data, offsets in slices(batch, "text", SLICE):
            bucket, first = tokens(data, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            for step in range(1, REACH + 1):
                near = np.flatnonzero(row[step:] == row[:-step])
                a, b = bucket[near], bucket[near + step]
                for x, y in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        total += np.bincount(x * WIDTH + place[y, k], weights=sign[y, k], minlength=BUCKETS * WIDTH)
    sums = total.reshape(BUCKETS, WIDTH)
    used = np.flatnonzero(sums.any(axis=1))
    if len(used):
        yield pa.record_batch([pa.array(used.astype(np.int32)), *(pa.array(sums[used, k]) for k in range(WIDTH))], names=["bucket", *(f"v{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all buckets (zero for unseen ones), from all rows."""
    names = [f"v{k}" for k in range(WIDTH)]
    schema = "bucket int, " + ", ".join(f"{c} double" for c in names)
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_neighbours, schema)
    table = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
    if table.num_rows:
        out[table.column("bucket").to_numpy()] = np.stack([table.column(c).to_numpy() for c in names], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each row's token vectors; zeros for a row without tokens."""
    n = len(offsets) - 1
    bucket, first = tokens(data, offsets)
    many = np.diff(first)
    full = np.flatnonzero(many)
    out = np.zeros((n, 2 * WIDTH), dtype=np.float32)
    if len(full):
        v = vectors[bucket]
        size = many[full][:, None].astype(np.float32)
        mean = np.add.reduceat(v, first[:-1][full], axis=0) / size
        square = np.add.reduceat(v * v, first[:-1][full], axis=0) / size
        out[full, :WIDTH] = mean
        out[full, WIDTH:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Network:
    """``sigmoid((relu((x - shift) / scale @ w1 + b1) @ w2 + b2) / temperature)``."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 2e-3, decay: float = 1e-3) -> Network:
    """Adam on the mean log loss; a fixed seed, so equal rows in equal order give the same network."""
    rng = np.random.default_rng(5)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - shift) / scale
    params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), batch):
            rows = order[a : a + batch]
            h = np.maximum(z[rows] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            d = (p - y[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (h > 0)
            grads = [z[rows].T @ dh + decay * params[0], dh.sum(axis=0), h.T @ d + decay * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(shift, scale, params[0], params[1], params[2], float(params[3][0]))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    a, b, g = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    while b - a > 1e-4:
        c, d = b - g * (b - a), a + g * (b - a)
        if loss(c) < loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for _, data, offsets in slices(pa.record_batch([texts], names=["t"]), "t", SLICE):
            x = pooled(self.vectors, data, offsets)
            parts.append(self.network.scores(x) if self.network else np.full(len(x), self.share))
        return pa.array(np.concatenate(parts).astype(float))


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                label_id: str = "doc_id", modulus: int = 5, held: int = 0, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Vectors from all rows, the network from at most about ``fit_rows`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    vectors = word_vectors(docs, text)
    marks = labels.where(F.col(label).isin(0, 1)).where(learns(label_id, modulus, held))
    marks = stored(marks.groupBy(F.col(label_id).alias("id")).agg(F.min(label).cast("int").alias("y")), "quality-labels")
    share = min(1.0, fit_rows / max(1, marks.count()))
    key = F.xxhash64("id", F.lit("fit"))
    drawn = marks.where((F.shiftrightunsigned(key, 11) / float(1 << 53)) < share)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", SLICE):
                x = pooled(shared.value, data, offsets)
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array([v.tobytes() for v in x], type=pa.binary())], names=["h", "y", "x"])

    # the sample has at most about `fit_rows` ids of 12 bytes, so it is sent to the texts and not the other way round
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.select(F.xxhash64("id", "text").alias("h"), "y", "text").mapInArrow(features, "h bigint, y int, x binary")
    got = rows.toArrow()
    y = got.column("y").to_numpy().astype(float)
    positive = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 10 or y.min() == y.max():
        return QualityModel(vectors, None, positive)
    h = got.column("h").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float32).reshape(len(y), -1).astype(float)
    order = np.argsort(h, kind="stable")
    x, y, h = x[order], y[order], h[order]
    apart = mix(h.view(np.uint64)) % np.uint64(5) == 0
    if apart.all() or not apart.any() or y[~apart].min() == y[~apart].max():
        apart = np.zeros(len(y), dtype=bool)
    network = fit_network(x[~apart], y[~apart])
    if apart.any() and y[apart].min() != y[apart].max():
        network.temperature = calibrate(network.logits(x[apart]), y[apart])
    return QualityModel(vectors, network, positive)


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1 (higher: label 1 is likelier) added; returns it and the column's name."""
    model = fit_quality(docs, labels, text=text, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = fresh("score", docs.columns)

    def run(texts: pa.Array) -> pa.Array:
        return shared.value.scores(texts)

    return docs.withColumn(at, F.arrow_udf(run, "double").asNondeterministic()(F.col(text))), at
