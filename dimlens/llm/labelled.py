"""Labels of documents, split into those to learn from and those held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def known_labels(labels: DataFrame, name: str, held: Column) -> DataFrame:
    """(doc_id, label) outside the held-out fold, one row per id: 0 and 1 only, the larger of several."""
    chosen = labels.select("doc_id", F.col(name).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held)
    return chosen.groupBy("doc_id").agg(F.max("label").alias("label"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrated(scores: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts of positives and negatives per score.

    Newton steps with targets drawn in from 0 and 1, so that separable counts stay finite.
    """
    p, n = positive.sum(), negative.sum()
    targets = (positive * (p + 1) / (p + 2) + negative / (n + 2))
    weight, spread = positive + negative, float(np.sqrt(np.average(scores**2, weights=positive + negative))) or 1.0
    x = np.stack([scores / spread, np.ones_like(scores)])
    w = np.zeros(2)
    for _ in range(50):
        q = logistic(w @ x)
        gradient = x @ (weight * q - targets) + 1e-6 * w
        curvature = (x * (weight * q * (1 - q))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-12))
    return float(w[0] / spread), float(w[1])
