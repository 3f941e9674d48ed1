"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.llm.labelled import calibrated, held_out, known_labels, logistic
from dimlens.llm.storage import in_slices, stored, texts

STATISTICS = ("chars", "words", "word_chars", "distinct", "repeated", "upper", "digits", "symbols",
              "punctuation", "lines", "short_lines", "distinct_lines")
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and not _CLASS[c]]] = 3
_CLASS[[c for c in range(0x80, 0xC0)]] = 5
BINS = 400


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text, in the order of STATISTICS; logs and logits of shares."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    _, upper, digits, symbols, points, inner = np.bincount(_CLASS[raw], minlength=6).tolist()
    chars, words = len(raw) - inner, text.split()
    upper += sum(map(str.isupper, text)) - upper if inner else 0
    n, distinct, lines = len(words), len(set(words)), text.split("\n")
    repeated = sum(map(str.__eq__, words, words[1:]))
    return [np.log1p(chars), np.log1p(n), np.log1p((chars - n) / max(n, 1)), _logit(distinct, n),
            _logit(repeated, max(n - 1, 0)), _logit(upper, chars), _logit(digits, chars),
            _logit(symbols, chars), _logit(points, chars), np.log1p(len(lines)),
            _logit(sum(len(x) < 40 for x in lines), len(lines)), _logit(len(set(lines)), len(lines))]


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, features) with an array of statistics of each whole text."""
    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        return in_slices(column, lambda batch: [statistics(t) for t in batch], pa.list_(pa.float64()))

    return texts(documents).select("doc_id", measured("text").alias("features"))


class Discriminant(NamedTuple):
    """Mean, inverse Cholesky factor and log of the density's scale, for classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, from Mahalanobis distances."""
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
                for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return logs[1] - logs[0]


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float, round_: float) -> Discriminant:
    """From count, sum and sum of squares per class. A class's covariance is shrunk to the pooled
    one by the share ``pooled``, then to a sphere of its mean variance by ``round_``."""
    means, covariances = [], []
    for n, total, squares in (moments[0], moments[1]):
        means.append(total / n)
        covariances.append(squares / n - np.outer(total / n, total / n))
    counts = np.array([moments[k][0] for k in (0, 1)])
    common = np.tensordot(counts / counts.sum(), np.array(covariances), axes=1)
    factors, offsets = [], []
    for k in (0, 1):
        s = (1 - pooled) * covariances[k] + pooled * common
        s = (1 - round_) * s + (round_ * np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def _moments(known: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the features of each label; one row per task travels."""
    d = len(STATISTICS)

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack(batch["features"].to_numpy()) if len(batch) else np.empty((0, d))
            for label in np.unique(batch["label"]):
                rows = x[batch["label"].to_numpy() == label]
                held[label] = held.get(label, 0) + np.concatenate(
                    [[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        yield pd.DataFrame([(int(k), i, v) for k, sums in held.items() for i, v in enumerate(sums)],
                           columns=["label", "position", "value"])

    sums = known.mapInPandas(partial, "label int, position int, value double").groupBy(
        "label", "position").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two labels, as many rows as a covariance has cells
        found.setdefault(r["label"], np.zeros(1 + d + d * d))[r["position"]] = r["value"]
    return {k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in found.items()}


def score(documents: DataFrame, labels: DataFrame, name: str = "quality", modulus: int = 4,
          remainder: int = 2, pooled: float = 0.1, round_: float = 0.01,
          threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of documents.

    Statistics of each whole text are modelled as a normal distribution per class with shrunken
    covariances. Count, mean and covariance are summed over all labelled documents that are not
    held out. The score is the difference of log-densities, put on a logistic curve fitted to the
    same documents' differences, counted in bins.

    Null and empty texts have the statistics of an empty text. Labels that are neither 0 nor 1 are
    left out, the larger of several for one id holds. Without labels of both classes every score
    is the share of label 1, or 0.5 without any. An empty table gives an empty result.
    """
    held = held_out(modulus, remainder)
    measured = stored(features(documents), "features")
    known = stored(measured.join(known_labels(labels, name, held), "doc_id").select("features", "label"), "known")
    moments = _moments(known)
    if len(moments) < 2:
        share = float([*moments][0]) if moments else 0.5
        value = F.lit(share)
    else:
        model = fit(moments, pooled, round_)

        @F.arrow_udf("double")
        def difference(column: pa.Array) -> pa.Array:
            return pa.array(model.difference(np.asarray(column.flatten()).reshape(len(column), -1)))

        clipped = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), difference("features")))
        width = 200.0 / BINS
        bins = known.groupBy(F.floor(clipped / width).alias("bin")).agg(
            F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).toPandas()
        slope, offset = calibrated((bins["bin"].to_numpy(float) + 0.5) * width,
                                   bins["p"].to_numpy(float), bins["n"].to_numpy(float))
        value = 1 / (1 + F.exp(-(clipped * max(slope, 0.0) + offset)))
    scored = measured.select("doc_id", held.alias("held_out"), value.cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
