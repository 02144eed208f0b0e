"""A quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are trigrams of character classes (letters, case, digits, kinds of punctuation, other bytes) and patterns of word
repetition, so the space has a fixed size and knows no language.  Term weights are square-rooted frequencies times
inverse document frequency; a truncated SVD of the labelled sample gives the latent space.  The labelled vectors (at most
``TRAIN`` of ``DIM`` floats, under 2 MB) are broadcast; each block of documents is multiplied by all of them exactly, and
the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .labelled import fold, training_rows
from .store import bound_batches

TRAIN = 4000
DIM = 48
NEIGHBOURS = 25
SHARPNESS = 8

# Fixed classes of bytes: 0 other punctuation and symbols, then as listed; bytes over 127 are one class.
CLASSES = (b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!", b"?", b"|", b"*", b"#$%&@~^=+", bytes(range(128, 256)))
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(CLASSES):
    CLASS[list(_c)] = _i + 1
TRIGRAMS = 16**3
EXTRAS = 16
TERMS = TRIGRAMS + EXTRAS
_ROLL = K.Rolling(31, fold_case=True)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x TERMS."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    c = CLASS[data]
    if len(c) >= 3:
        tri = c[:-2] * 256 + c[1:-1] * 16 + c[2:]
        same = doc[:-2] == doc[2:]
        out[:, :TRIGRAMS] = np.bincount((doc[:-2] * TRIGRAMS + tri)[same], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    w = K.Words(data, offsets)
    if len(w.start):
        h, d = _ROLL.ranges(_ROLL.prefix(data), w.start, w.end), w.doc()
        for lag in (1, 2, 3):
            hit = (h[lag:] == h[:-lag]) & (d[lag:] == d[:-lag])
            out[:, TRIGRAMS + lag] = 4 * np.bincount(d[lag:][hit], minlength=n)
        length = np.minimum(w.end - w.start, 23) // 3
        out[:, TRIGRAMS + 8 : TRIGRAMS + 16] = np.bincount(d * 8 + length, minlength=n * 8).reshape(n, 8)
    return out


@dataclass(frozen=True)
class QualityModel:
    """A fitted model; ``vectors`` is empty when there was nothing to learn from."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    base: float
    neighbours: int = NEIGHBOURS

    def project(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum(1, keepdims=True)
        return self.place(np.sqrt(counts / np.maximum(total, 1)) * self.idf)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of weighted terms."""
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.base)
        some = np.flatnonzero(counts.sum(1))
        if not len(self.vectors) or not len(some):
            return out
        k = min(self.neighbours, len(self.vectors))
        cos = self.project(counts[some]) @ self.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** SHARPNESS * self.weights[near] + 1e-12
        out[some] = (w * self.labels[near]).sum(1) / w.sum(1)
        return out


def fit(counts: np.ndarray, y: np.ndarray, dim: int = DIM, neighbours: int = NEIGHBOURS, spend: bool = False) -> QualityModel:
    """``spend``: the weights take the place of the counts, so that a driver holds one such table only."""
    if not len(y):
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + 1
    x = np.divide(counts, np.maximum(counts.sum(1, keepdims=True), 1), out=counts if spend else None)
    np.multiply(np.sqrt(x, out=x), idf, out=x)
    # randomised range finder with two power iterations, then a small exact decomposition
    dim = min(dim, *x.shape)
    q = np.linalg.qr(x @ np.random.Generator(np.random.PCG64(5)).standard_normal((x.shape[1], dim + 16)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dim].T.astype(np.float32)
    share = np.array([max(1, int((y == v).sum())) for v in (0, 1)]) / len(y)
    weights = 1 / np.sqrt(share[y.astype(int)])  # half-way to balanced classes
    model = QualityModel(idf, basis, np.zeros((0, 1)), y.astype(float), weights, float((y * weights).sum() / weights.sum()), neighbours)
    return QualityModel(idf, basis, model.place(x), model.labels, weights, model.base, neighbours)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = TRAIN, text: str = "text", id: str = "doc_id") -> QualityModel:
    """Fit on at most ``most`` labelled rows outside the held-out fold.  Only their term counts come to the driver."""
    rows = training_rows(docs, labels, "quality", folds, held_out, most, text, id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                packed = [zlib.compress(r.tobytes(), 1) for r in term_counts(data, offsets)]  # most are 0
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id"), K.column(part, "y"), K.binaries(packed)], ["doc_id", "y", "terms"])

    found = rows.mapInArrow(run, "doc_id long, y int, terms binary").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for row, i in enumerate(order.tolist()):
        counts[row] = np.frombuffer(zlib.decompress(found["terms"][i].as_py()), np.float32)
    y = found["y"].to_numpy()[order]
    del found
    return fit(counts, y, spend=True)


def score(docs: DataFrame, model: QualityModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the model's base rate.  Repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id"), pa.array(np.clip(shared.value.score(term_counts(data, offsets)), 0, 1), pa.float64())], ["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row.  A null id is never held out; without labels all scores are 0.5.

    The label tables's columns doc_id and quality are read; columns other than id and text of the documents are not.
    """
    scored = score(docs, train(docs, labels, folds, held_out, **options), **{k: v for k, v in options.items() if k in ("text", "id")})
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns unchanged, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, **options))

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["t"])
        return pd.Series(np.concatenate([np.zeros(0), *(shared.value.score(term_counts(data, offsets)) for _, data, offsets in K.pieces(batch, "t"))]))

    bound_batches(docs.sparkSession)
    return docs.filter(scored(F.col(text).cast("string")) >= 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
