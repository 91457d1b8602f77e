"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import blobs, bounded_batches, held_out, quoted

#: Byte pairs fold into so many terms; after them come terms of shape.
PAIR_TERMS = 1024
SHAPES, STEPS = 6, 12
TERMS = PAIR_TERMS + SHAPES * STEPS
#: Bytes looked at at once, so that a very long text needs no more memory.
SLICE = 1 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 3
_CLASS[128:] = 3
_PAIR = (np.arange(65536, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)


def term_counts(data: bytes) -> np.ndarray:
    """How often each term occurs in the whole text. A shape (length, shares of upper case, of other signs, of distinct words and of words that repeat the one before, mean word length) is one term by its step."""
    counts = np.zeros(TERMS, np.float32)
    kinds = np.zeros(4, np.int64)
    for start in range(0, len(data), SLICE):
        x = np.frombuffer(data, np.uint8, min(SLICE + 1, len(data) - start), start)
        if len(x) > 1:
            counts[:PAIR_TERMS] += np.bincount(_PAIR[x[:-1].astype(np.uint16) * np.uint16(256) + x[1:]], minlength=PAIR_TERMS)
        kinds += np.bincount(_CLASS[x[:SLICE]], minlength=4)
    words = data.split()
    n, letters = max(1, len(words)), max(1, int(kinds[2] + kinds[3]))
    shapes = (np.log2(1 + len(data)) / 2, STEPS * kinds[2] / letters, STEPS * kinds[0] / max(1, len(data)) * 2, STEPS * len(set(words)) / n, len(data) / n, 1.5 * STEPS * sum(map(eq, words, words[1:])) / n)
    for k, value in enumerate(shapes):
        counts[PAIR_TERMS + k * STEPS + int(min(STEPS - 1, value))] = 1
    return counts


@dataclass
class Model:
    """Inverse document frequencies, the projection, the neighbours' unit vectors and labels, and the share of label 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    shape_weight: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf, self.shape_weight) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes], block: int = 512) -> np.ndarray:
        """Between 0 and 1. Without labelled documents 0.5; if no neighbour has a positive cosine, the share of label 1. Of equal cosines at the
        last place, the vector that stands first in the sample is the neighbour."""
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(texts), block):
            cosines = self.embed(np.stack([term_counts(x) for x in texts[i : i + block]])) @ self.vectors.T
            weight = np.where(nearest(cosines, k), np.maximum(cosines, 0), 0).astype(np.float64)
            total = weight.sum(1)
            vote = weight @ self.labels
            out[i : i + block] = np.where(total > 0, np.clip(vote / np.maximum(total, 1e-300), 0, 1), self.prior)
        return out


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` largest of each row are; of equal ones at the edge, the first."""
    edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    above, at = cosines > edge, cosines == edge
    return above | (at & (np.cumsum(at, axis=1) <= k - above.sum(1, keepdims=True)))


def weighted(counts: np.ndarray, idf: np.ndarray, shape_weight: float) -> np.ndarray:
    """Unit rows: log frequencies by idf for byte pairs, then the shapes with a fixed share."""
    x = np.log1p(counts[:, :PAIR_TERMS]) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.concatenate([x, counts[:, PAIR_TERMS:] * shape_weight], axis=1).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, max_labelled: int = 4096, dimensions: int = 48, neighbours: int = 15, shape_weight: float = 0.5) -> Model:
    """Fit on the labelled rows whose crc32(id as text) mod ``folds`` is not ``fold``.

    The sample is bounded: of the rows that have both, the ``max_labelled`` with the smallest hash of the id, alike at any size of the
    corpus, as vectors of TERMS counts (17 MB for the default). Rows without a label, and documents without labels, are left out; of
    an id labelled twice the larger label counts. Without any labelled row the model scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    # only ids that have a document, so that no label without one takes a place
    own = docs.select(quoted(id_col).cast("long").alias("doc_id"))
    chosen = known.join(own, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([term_counts(x).tobytes() for x in b.column("data").to_pylist()], pa.binary())], ["doc_id", "label", "counts"])

    sample = blobs(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "data").mapInArrow(count, "doc_id long, label int, counts binary")
    rows = sample.orderBy(order, "doc_id", "counts").limit(max_labelled).collect()
    labelled = np.array([r["label"] for r in rows], np.float64)
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts[:, :PAIR_TERMS] > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(counts, idf, shape_weight)
    values, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x) if rows else (np.ones(TERMS), np.eye(TERMS))
    axes = vectors[:, np.argsort(-values)[:dimensions]].astype(np.float32)
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labelled, float(labelled.mean()) if rows else 0.5, neighbours, shape_weight)
    if rows:
        model.vectors = model.embed(counts)
    return model


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each whole text (null: empty) as a column, so that filtering by it needs neither join nor shuffle."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(data: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score(data.tolist()))

    return score(F.coalesce(quoted(text_col), F.lit("")).cast("binary"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= 0.5). Nothing but the text goes into a score.

    Null text counts as empty and is scored by its shape. Equal texts have equal scores. A null id is
    held out if crc32 of the empty text says so. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, folds=folds, fold=fold, **how)
    key = quoted(id_col).cast("long")
    scored = docs.select(key.alias("doc_id"), held_out(key, folds, fold).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    return docs.where(score_column(docs, model, text_col) >= threshold)
