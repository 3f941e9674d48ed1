"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimlens.llm.storage import stored
from dimlens.llm.vectors import best, in_blocks, matrix, ranked, usable

#: Queries and candidates in a block.
BLOCK = (256, 4096)
SCHEMA = "query_id long, vec_id long, score double"


class Router(NamedTuple):
    """A classifier with one hidden layer from vectors to partitions."""

    centre: np.ndarray
    scale: float
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        x = np.maximum(((vectors - self.centre) / self.scale) @ self.hidden + self.hidden_bias, 0)
        z = x @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest other rows of each row, in chunks."""
    squares = (vectors**2).sum(axis=1)
    found = np.empty((len(vectors), k), dtype=np.int64)
    for at in range(0, len(vectors), 512):
        far = squares[None, :] - 2 * (vectors[at:at + 512] @ vectors.T)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        found[at:at + 512] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return found


def balanced_partition(near: np.ndarray, levels: int, seed: int) -> np.ndarray:
    """2**levels equal parts of a neighbour graph that cut few of its edges.

    Each part is halved at the median of the smoothest vector on its graph: the second eigenvector
    of the averaging over neighbours, by power iteration.
    """
    random = np.random.default_rng(seed)
    part = np.zeros(len(near), dtype=np.int64)
    for _ in range(levels):
        halves = np.zeros(len(near), dtype=np.int64)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            position = np.full(len(near), -1)
            position[own] = np.arange(len(own))
            target = position[near[own]]
            a, b = np.repeat(np.arange(len(own)), near.shape[1])[target.ravel() >= 0], target[target >= 0]
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            degree = np.bincount(a, minlength=len(own)) + 1.0
            x = random.standard_normal(len(own))
            for _ in range(60):
                x = x - (x * degree).sum() / degree.sum()
                x = (x + np.bincount(a, weights=x[b], minlength=len(own))) / degree
                x /= np.linalg.norm(x) + 1e-300
            order = np.argsort(x, kind="stable")
            halves[own[order[len(own) // 2:]]] = 1
        part = part * 2 + halves
    return part


def train_router(vectors: np.ndarray, targets: np.ndarray, seed: int,
                 width: int = 128, epochs: int = 40) -> Router:
    """Cross-entropy against the shares of partitions among each row's neighbours, by Adam."""
    random = np.random.default_rng(seed)
    centre = vectors.mean(axis=0)
    scale = float(np.sqrt(((vectors - centre) ** 2).mean())) or 1.0
    x = (vectors - centre) / scale
    shapes = [(x.shape[1], width), (width,), (width, targets.shape[1]), (targets.shape[1],)]
    p = [random.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for epoch in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            step += 1
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            rate = 2e-3 * (1 - epoch / epochs) + 1e-4
            for i, d in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(centre, scale, *p)


def fit(vectors: np.ndarray, levels: int, recall: float, seed: int = 7) -> tuple[Router, int]:
    """A router, and how many partitions find the share ``recall`` of known neighbours.

    Every fifth row is left out of the training and used to count how many are needed.
    """
    near = neighbours(vectors, min(16, len(vectors) - 1))
    part = balanced_partition(near, levels, seed)
    targets = np.zeros((len(vectors), 2**levels))
    for column in (*near.T, np.arange(len(vectors))):
        np.add.at(targets, (np.arange(len(vectors)), part[column]), 1)
    targets /= targets.sum(axis=1, keepdims=True)
    tested = np.arange(len(vectors)) % 5 == 0
    router = train_router(vectors[~tested], targets[~tested], seed)
    likely = np.argsort(-router.probabilities(vectors), axis=1, kind="stable")
    place = np.argsort(likely[tested], axis=1)
    place = np.take_along_axis(place, likely[:, 0][near[tested]], axis=1)
    return router, 1 + int(np.quantile(place, recall, method="inverted_cdf"))


def nearest(embeddings: DataFrame, is_query, k: int = 10, sample: int = 8192, levels: int = 4,
            recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found, by Euclidean distance.

    The index is learned from a sample of at most ``sample`` vectors, those whose ids hash lowest:
    their neighbour graph is cut into 2**``levels`` balanced partitions, and a classifier of one
    hidden layer learns in which partitions a vector's neighbours lie. Every row of the table is
    indexed under its most probable partition. A query searches as many of its most probable
    partitions as find the share ``recall`` of the neighbours of sample rows kept out of the
    training, and more while those hold no more than k rows; all rows found are ranked by their
    exact distance. A partition that holds many rows, or many copies of one vector, is split into
    blocks.

    Queries are the rows that the condition ``is_query`` selects; a query's own vec_id is no
    candidate. Ties go to the smaller vec_id. Which vectors take part: see ``vectors.usable``; zero
    vectors do not. A table of no more than k + 1 vectors gives each query all others.
    """
    vectors = stored(usable(embeddings, zero=False), "vectors")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    known = matrix(chosen["vector"]) if len(chosen) else np.empty((0, 1))
    levels = min(levels, max(0, int(np.log2(max(1, len(known) // 32)))))
    router, probes = fit(known, levels, recall) if levels else (None, 1)

    @F.arrow_udf("array<int>")
    def order(column: pa.Array) -> pa.Array:
        x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
        likely = (np.argsort(-router.probabilities(x), axis=1, kind="stable") if router
                  else np.zeros((len(x), 1)))
        return pa.array(list(likely.astype(np.int32)), type=pa.list_(pa.int32()))

    indexed = stored(vectors.withColumn("order", order("vector")).withColumn("part", F.col("order")[0]), "indexed")
    rows = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = F.create_map(*(F.lit(x) for i in ({-1: 0} | rows).items() for x in i))
    # the partitions before the i-th hold: enough once over k rows, as one of them may be the query
    held = F.aggregate("order", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(
        a, F.array(F.element_at(a, -1) + F.coalesce(sizes[p], F.lit(0)))))
    asked = indexed.where(is_query).withColumn("held", held).withColumn(
        "probed", F.filter("order", lambda p, i: (i < probes) | (F.col("held")[i] <= k)))
    asked = stored(asked.select("vec_id", "vector", F.explode("probed").alias("part")), "asked")
    counts = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = {p: (n, rows[p]) for p, n in counts.items() if p in rows}

    def rerank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, candidates = np.asarray(right["vec_id"].combine_chunks()), matrix(right["vector"])
        queries, found = matrix(left["vector"]), []
        for query_id, query in zip(left["vec_id"].to_pylist(), queries, strict=True):
            far = np.sqrt(((candidates - query) ** 2).sum(axis=1))
            far[ids == query_id] = np.inf
            top = best(-far, ids, k)
            top = top[np.isfinite(far[top])]
            found.append((np.full(len(top), query_id), ids[top], far[top]))
        return pa.table([np.concatenate([f[i] for f in found] or [np.empty(0)]).astype(t)
                         for i, t in enumerate((np.int64, np.int64, np.float64))],
                        names=["query_id", "vec_id", "score"])

    wanted = F.col("part").isin([*parts])
    return ranked(in_blocks(asked.where(wanted), indexed.where(wanted).select("vec_id", "vector", "part"),
                            parts, rerank, SCHEMA, BLOCK), k, True)
