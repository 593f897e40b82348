"""Quality classifier on random-indexing word vectors.

Every token bucket has a sparse random index vector.  A bucket's word vector is the sum of the index vectors of its neighbours over the
whole corpus; tasks sum their own part, so what is shuffled is one row for each bucket and task.  A document is pooled to the mean and
spread of its word vectors, and a two-layer network with a temperature fitted on rows apart turns this into a probability."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import documents, map_batches

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Size of the word table: tokens share buckets by hash, so the table never grows with the corpus.
BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 15, 32, 4, 2
WIDTH = 2 * DIMENSIONS + 3
CHUNK = 1 << 16
#: Labelled rows that the network is fitted on, at most, chosen by a hash of their id.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 3e-3, 1e-4, 7
ACCEPT = 0.7
TOKENS_KEPT = 500_000

_buckets: dict[str, int] = {}


def buckets(text: str) -> np.ndarray:
    """Bucket of each token, in order."""
    tokens = TOKEN.findall(text)
    if len(_buckets) > TOKENS_KEPT:
        _buckets.clear()
    for t in [t for t in {*tokens} if t not in _buckets]:
        _buckets[t] = zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS
    return np.fromiter(map(_buckets.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.float64)


def word_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMENSIONS unit vectors from all rows of ``docs``; buckets without neighbours are zero."""
    columns = [f"v{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        places, signs = index_vectors()
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for text in batch.column(1):
                ids = buckets(text.as_py())
                for at in range(0, len(ids), CHUNK):
                    part = ids[max(0, at - REACH) : at + CHUNK]
                    fresh = at - max(0, at - REACH)
                    for far in range(1, REACH + 1):
                        a, b = part[max(0, fresh - far) : len(part) - far], part[max(far, fresh) :]
                        for mine, other in ((a, b), (b, a)):
                            for k in range(NONZERO):
                                np.add.at(sums, mine * DIMENSIONS + places[other, k], signs[other, k])
        table = sums.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield {"bucket": used, **{c: table[used, i].astype(np.int64) for i, c in enumerate(columns)}}

    parts = map_batches(documents(docs, id_col, text_col), run, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    # One row for each bucket at most, whatever the corpus.
    found = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    table = np.zeros((BUCKETS, DIMENSIONS))
    if found.num_rows:
        table[found["bucket"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], axis=1)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors, mean likeness of neighbours, share of words said one or two places before, length.

    Zeros for a text without tokens."""
    ids = buckets(text)
    out = np.zeros(WIDTH)
    if not len(ids):
        return out
    first, second, near = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0
    for at in range(0, len(ids), CHUNK):
        x = vectors[ids[at : at + CHUNK + 1]]
        near += float(np.einsum("ij,ij->", x[1:], x[:-1]))
        x = x[:CHUNK]
        first += x.sum(axis=0)
        second += np.square(x).sum(axis=0)
    mean = first / len(ids)
    out[:DIMENSIONS] = mean
    out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(second / len(ids) - mean**2, 0))
    again = np.mean((ids[2:] == ids[1:-1]) | (ids[2:] == ids[:-2])) if len(ids) > 2 else 0.0
    out[-3:] = near / max(len(ids) - 1, 1), again, np.log1p(len(ids))
    return out


def features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, x array<float>, ...) for each row of ``docs``; further columns are simple ones and go through."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    source = documents(docs, id_col, text_col, *more)
    names = source.columns[2:]
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value
        for batch in batches:
            yield {"doc_id": batch.column(0), "x": [pooled(t.as_py(), table).astype(np.float32) for t in batch.column(1)], **{n: batch.column(i + 2) for i, n in enumerate(names)}}

    return map_batches(source, run, "doc_id long, x array<float>" + kinds)


@dataclass
class Network:
    """Two layers on standardised inputs; probabilities after division by the temperature."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, a sixth of the rows kept for the temperature.  No rows, or one class: the smoothed base rate."""
    x, y = np.asarray(x, float).reshape(len(y), -1 if len(y) else WIDTH), np.asarray(y, float)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    middle, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(SEED)
    net = Network(middle, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), base, 1.0)
    if len(set(y.tolist())) < 2:
        return net
    kept = np.arange(len(y)) % 6 == 5
    z, t = (x - middle)[~kept] / scale, y[~kept]
    params = [net.w1, net.b1, rng.normal(0, 0.1, HIDDEN), np.array([base])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            w1, b1, w2, b2 = params
            h = np.tanh(z[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40))) - t[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - h**2)
            slopes = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), h.T @ error + DECAY * w2, np.array([error.sum()])]
            step += 1
            for p, g, (m, v) in zip(params, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, truth = net.logits(x[kept]), y[kept]
    if len(truth):
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        net.temperature = float(tried[np.argmin([np.mean(np.logaddexp(0, -(2 * truth - 1) * logit / c)) for c in tried])])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Network:
    """Network from at most ``fit_rows`` labelled rows of ``features`` that are not held out; unlabelled and null labels don't count."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    # Only about as many rows as wanted are brought together, however many tasks there are.
    part = min(1.0, 1.1 * fit_rows / max(1, known.count()))
    known = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = rows.join(known, "doc_id").select("x", "y", "h").orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(fit_rows).toArrow()
    x = np.stack(sample["x"].to_numpy()) if sample.num_rows else np.zeros((0, WIDTH))
    return train(x, sample["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *more: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...) for each row of ``docs``, learned from its labelled rows that are not held out.

    Null and empty texts are scored by the network like any text, as having no tokens; repeated rows get equal scores."""
    rows = stage(features(docs, word_vectors(docs, id_col, text_col), id_col, text_col, *more), "quality-features")
    net = fit(rows, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, WIDTH)
            yield {n: batch.column(n) for n in kept} | {"score": net.probabilities(x)}

    kept = [c for c in rows.columns if c != "x"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    return map_batches(rows, run, f"{kinds}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), *kept[1:])


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least the threshold; fitted as in ``score``, applied without a shuffle."""
    vectors = word_vectors(docs, id_col, text_col)
    net = fit(features(docs, vectors, id_col, text_col), labels, id_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([pooled(t.as_py() or "", shared.value) for t in batch.column(text_col)]).reshape(batch.num_rows, WIDTH)
            yield batch.filter(pa.array(net.probabilities(x.astype(np.float32).astype(float)) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
