"""Bounded labelled samples and logistic regression on a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled documents, those with the smallest hashes.

    Held-out rows, null labels and null ids are left out; an id with both labels has the larger. The
    chosen ids are bounded by ``most``, so the documents are found without moving their texts.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("known_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.dropna().where(~held_out(F.col("known_id"))).groupBy("known_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("known_id"), "known_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).select("doc_id", "text", "label")


class Logistic:
    """Ridge logistic regression by Newton steps; features are standardised first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.spread = np.where(spread > 0, spread, 1.0)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -35, 35)))
            gradient = z.T @ (y - p) - penalty * self.beta
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.beta[0] + ((x - self.mean) / self.spread) @ self.beta[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))
