"""Toxicity by non-negative learning from positive and unlabelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.llm.labelled import held_out, known_labels, logistic
from dimlens.llm.storage import in_slices, stored, texts

WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
PREFIX = 4
#: Strongest words of a document that its score looks at, one by one.
STRONGEST = 6
#: Words beyond these strengths are counted.
STRONG = (1.5, 3.0, 4.5)
#: Words remembered by one Python worker.
REMEMBERED = 200_000


class _Codes(dict):
    """Two buckets of a word in one number: that of the word and that of its beginning."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        beginning = b"^" + word[:PREFIX].encode()
        found = self[word] = (crc32(word.encode()) % BUCKETS) << 32 | crc32(beginning) % BUCKETS
        return found


_codes = _Codes()


def word_codes(text: str) -> np.ndarray:
    """The code of each distinct lower-cased word of a whole text, sorted."""
    words = set(WORD.findall(text.lower()))
    return np.sort(np.fromiter(map(_codes.__getitem__, words), dtype=np.int64, count=len(words)))


def buckets(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1).astype(np.int32)


def excess(held: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each bucket, how far confirmed documents hold it beyond unlabelled ones, in log-deviations.

    ``held`` has the number of documents that hold a bucket, of the confirmed and of the others.
    """
    expected = documents[0] * (held[1] + 1) / (documents[1] + 2)
    deviations = (held[0] - expected) / np.sqrt(expected + 1)
    return np.sign(deviations) * np.log1p(np.abs(deviations))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the corrected risk, by margin of positive and of unlabelled examples.

    With logistic loss: prior * R(P as 1) + max(0, R(U as 0) - prior * R(P as 0)). Where the second
    part is negative the learner fits the unlabelled positives as negatives, and the step goes
    back: its gradient is turned round.
    """
    as_one = -prior * logistic(-positive) / len(positive)
    p_as_zero = prior * logistic(positive) / len(positive)
    u_as_zero = logistic(unlabelled) / len(unlabelled)
    rest = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    if rest < 0:
        return p_as_zero, -u_as_zero
    return as_one - p_as_zero, u_as_zero


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.step, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        scale = np.sqrt(self.v / (1 - 0.99**self.step)) + 1e-8
        return self.rate * (self.m / (1 - 0.9**self.step)) / scale


def summary(strength: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """What the classifier sees: the strongest words one by one, how many are strong, and of how many."""
    words = np.sort(strength[buckets].sum(axis=1))[::-1]
    top = np.zeros(STRONGEST)
    top[:min(STRONGEST, len(words))] = words[:STRONGEST]
    return np.concatenate([top, [np.log1p((words > t).sum()) for t in STRONG], [np.log1p(len(words))]])


class Model(NamedTuple):
    strength: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        x = (summary(self.strength, buckets(word_codes(text))) - self.centre) / self.spread
        return float(logistic(np.array(x @ self.weights + self.bias)))


class _Sample(NamedTuple):
    """Words of documents in ``rows``; ``places`` has the places of a row among the confirmed and the others."""
    rows: DataFrame
    places: dict[int, list[tuple[int, int]]]
    documents: tuple[int, int]

    @property
    def folds(self) -> int:
        return min(4, *self.documents)

    def held(self) -> np.ndarray:
        """The number of documents that hold a bucket, by kind and fold."""
        folds, shared = self.folds, self.rows.sparkSession.sparkContext.broadcast(self.places)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2, folds, BUCKETS), dtype=np.int32)
            for batch in batches:
                for row, codes in zip(batch["row"].to_pylist(), batch["codes"], strict=True):
                    if places := shared.value.get(row):
                        own = np.unique(buckets(np.asarray(codes.values)))
                        for kind, place in places:
                            counts[kind, place % folds, own] += 1
            flat = counts.reshape(-1)
            found = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found].astype(np.int64))], ["at", "n"])

        sums = self.rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        held = np.zeros(2 * folds * BUCKETS, dtype=np.int64)
        held[sums["at"].to_numpy()] = sums["n"].to_numpy()
        return held.reshape(2, folds, BUCKETS)

    def summaries(self, strengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``summary`` of each document by the strengths of its fold, of the confirmed and of the others."""
        folds, shared = self.folds, self.rows.sparkSession.sparkContext.broadcast((self.places, strengths))

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_places, own = shared.value
            for batch in batches:
                found = []
                for row, codes in zip(batch["row"].to_pylist(), batch["codes"], strict=True):
                    if places := all_places.get(row):
                        words = buckets(np.asarray(codes.values))
                        found += [(kind, place, summary(own[place % folds], words).tolist()) for kind, place in places]
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(
                    columns, (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["kind", "place", "x"])

        rows = self.rows.mapInArrow(summarise, "kind int, place int, x array<double>").toArrow().to_pylist()
        rows.sort(key=lambda r: (r["kind"], r["place"] % folds, r["place"]))
        p, u = (np.array([r["x"] for r in rows if r["kind"] == kind]) for kind in (0, 1))
        return p, u


def fit(sample: _Sample, prior: float) -> Model:
    """A linear classifier by the corrected risk over the strongest words of a document.

    How strong a document's words are is measured by the other folds of the sample, so that words
    of its own do not look strong; the model then measures by the whole sample. Documents are
    counted and summed up in tasks; arrays of fixed sizes reach the driver.
    """
    folds, held, documents = sample.folds, sample.held(), np.array(sample.documents)
    own = np.array([[len(range(f, n, folds)) for f in range(folds)] for n in documents])
    rest = [(held.sum(axis=1) - held[:, f], documents - own[:, f]) for f in range(folds)]
    whole = excess(held.sum(axis=1), documents)
    p, u = sample.summaries(np.array([whole] if folds == 1 else [excess(*r) for r in rest]))
    centre, spread = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-3)
    p, u = (p - centre) / spread, (u - centre) / spread
    w, move = np.append(np.zeros(p.shape[1]), np.log(prior / (1 - prior))), _Adam(p.shape[1] + 1, 0.05)
    for _ in range(1500):
        gp, gu = non_negative_risk(p @ w[:-1] + w[-1], u @ w[:-1] + w[-1], prior)
        w -= move(np.append(gp @ p + gu @ u + 1e-4 * w[:-1], gp.sum() + gu.sum()))
    return Model(whole.astype(np.float32), centre, spread, w[:-1], float(w[-1]))


def _sample(documents: DataFrame, ids: list[DataFrame], bounds: list[int]) -> _Sample:
    """All words of the documents whose ids, among the given ones, hash lowest."""
    @F.arrow_udf("array<long>")
    def codes(column: pa.Array) -> pa.Array:
        return in_slices(column, lambda batch: [word_codes(t) for t in batch], pa.list_(pa.int64()))

    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [stored(some.orderBy(*order).limit(n), "chosen") for some, n in zip(ids, bounds, strict=True)]
    # At most as many ids as the bounds; their texts are looked up without moving any other.
    some = documents.join(F.broadcast(chosen[0].union(chosen[1]).distinct()), "doc_id", "left_semi")
    rows = stored(texts(some).select("doc_id", codes("text").alias("codes"),
                                     F.monotonically_increasing_id().alias("row")), "sampled")
    places: dict[int, list[tuple[int, int]]] = {}
    found = []
    for kind, (own, n) in enumerate(zip(chosen, bounds, strict=True)):
        keys = rows.select("doc_id", "row", F.xxhash64("codes").alias("content")).join(
            F.broadcast(own), "doc_id", "left_semi")
        first = keys.orderBy(*order, "content", "row").select("row").limit(n).toArrow()["row"].to_pylist()
        found.append(len(first))
        for place, row in enumerate(first):
            places.setdefault(row, []).append((kind, place))
    return _Sample(rows, places, (found[0], found[1]))


def train(documents: DataFrame, labels: DataFrame, name: str = "toxic", held: Column | None = None,
          positives: int = 4000, unlabelled: int = 8000, prior: float | None = None) -> Model | None:
    """Learn from at most ``positives`` confirmed and ``unlabelled`` other or unknown documents.

    Labels outside the fold ``held`` are used, and only for which documents are confirmed; the
    unlabelled sample comes from all documents outside it. ``prior`` is the share of positives among
    all documents; without it, the share among the labelled ones stands in. It is kept
    0.0001 away from 0 and 1. These are the only bounds; learning and scoring cover every word of a document. None without a confirmed document.
    """
    held = F.lit(False) if held is None else held
    known = stored(known_labels(labels, name, held), "known")
    counts = known.agg(F.sum("label"), F.count("*")).first()
    if not counts[0]:
        return None
    prior = min(max(counts[0] / counts[1] if prior is None else prior, 1e-4), 1 - 1e-4)
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull() & ~held)
    confirmed = known.where("label = 1").select("doc_id").join(ids, "doc_id", "left_semi")
    sample = _sample(documents, [confirmed, ids], [positives, unlabelled])
    return fit(sample, prior) if all(sample.documents) else None


def scored(documents: DataFrame, labels: DataFrame, name: str = "toxic", held: Column | None = None,
           **bounds) -> Column:
    """The learned probability that the column text is toxic; see ``train``.

    Null and empty texts are scored as a text without words. Without a confirmed document outside
    the fold ``held`` it is 0.
    """
    model = train(documents.select("doc_id", "text"), labels, name, held, **bounds)
    if model is None:
        return F.lit(0.0)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("double")
    def score_of(column: pa.Array) -> pa.Array:
        own = shared.value
        return in_slices(column, lambda batch: [own.score(t or "") for t in batch], pa.float64())

    return score_of("text")


def score(documents: DataFrame, labels: DataFrame, name: str = "toxic", modulus: int = 3,
          remainder: int = 1, threshold: float = 0.7, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of documents.

    The score is the learned probability that a whole text is toxic; labels of held-out documents
    take no part in it. Labels other than 0 and 1 are left out, the larger of several for one id
    holds. An empty table gives an empty result.
    """
    held = held_out(modulus, remainder)
    found = documents.select("doc_id", held.alias("held_out"),
                             scored(documents, labels, name, held, **bounds).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
