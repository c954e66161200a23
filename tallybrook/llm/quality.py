"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled texts becomes TF-IDF vectors of hashed byte trigrams (and the share of words that repeat the word
before), a truncated eigenbasis of their Gram matrix is the latent space, and the sample's unit vectors in it are broadcast.
Every text's exact cosines to all of them are one blocked matrix product; the nearest vote with weights that fall with the
distance in similarity. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import give_back, key_text

#: Trigram buckets, latent dimensions, voters, and how fast a voter's weight falls with its cosine's distance from the best.
BUCKETS, DIMS, VOTERS, SHARPNESS = 1024, 64, 15, 50.0
#: Most labelled rows that a fit collects: 4,000 vectors of 1,025 floats are 16 MB on the driver, 1 MB when broadcast.
SAMPLE_ROWS = 4000
#: Texts in one matrix product.
BLOCK = 512


def features(texts: list[str | None]) -> np.ndarray:
    """Row-wise square roots of trigram shares, and the share of repeated words; zeros for a null or empty text."""
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) >= 3:
            b = np.frombuffer(raw, np.uint8).astype(np.uint32)
            h = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(22)
            out[i, :BUCKETS] = np.sqrt(np.bincount(h, minlength=BUCKETS) / len(h))
        words = raw.lower().split()
        if len(words) > 1:
            out[i, BUCKETS] = sum(map(bytes.__eq__, words[1:], words[:-1])) / (len(words) - 1)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Shares of votes for label 1; the sample's mean label for texts without features, 0.5 without a sample."""
        n = len(self.labels)
        if not n:
            return np.full(len(texts), 0.5)
        x = features(texts)
        sims = self.project(x) @ self.vectors.T
        k = min(VOTERS, n)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sims, near, 1).astype(np.float64)
        w = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
        votes = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(np.where(x.any(axis=1), votes, self.labels.mean()), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the ``max_rows`` labelled keys that come first by md5 of the key; null labels and keys are left out.

    A key with several labels counts with the largest, a key with several texts with one of them.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.md5(key_text("__k")), "__k").limit(max_rows)  # what is broadcast has max_rows rows at most
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k").dropDuplicates(["__k"])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                yield pd.DataFrame({"k": part["__k"].astype(str), "y": part["__y"], "x": [v.tobytes() for v in features(part["__t"].tolist())]})

    got = sorted(map(tuple, rows.mapInPandas(measured, "k string, y int, x binary").collect()))
    n = len(got)
    if not n:
        return Model(np.ones(BUCKETS + 1, np.float32), np.zeros((BUCKETS + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(g[2] for g in got), np.float32).reshape(n, BUCKETS + 1)
    idf = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    idf[BUCKETS] = 1
    z = (x * idf).astype(np.float64)
    _, vectors = np.linalg.eigh(z.T @ z)
    model = Model(idf, np.ascontiguousarray(vectors[:, ::-1][:, :DIMS]).astype(np.float32), np.zeros((0, 1)), np.array([g[1] for g in got], np.float64))
    model.vectors = model.project(x)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column expression: each text's score, from the broadcast model."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            parts = [held.value.score(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
            texts = s = None
        give_back()

    return of(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); columns of these names are replaced."""
    model = fit(docs, labels, key, text, label, max_rows)
    scored = docs.drop("score", "predicted").withColumn("score", score(docs, model, text))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
