"""Exact top-k by inner product in three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimlens.llm.storage import stored
from dimlens.llm.vectors import matrix, ranked, usable

SLICES = 4
#: Queries that one task holds, and groups that candidates are dealt over, whatever their number.
QUERIES, GROUPS = 16384, 8
#: Queries and candidates whose scores are held at a time.
CHUNK = (64, 4096)
SCHEMA = "query_id long, vec_id long, score long"
#: Below all scores: a query without k scores yet.
NONE = -2**62


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, vector) with components floor(scale * x); see ``vectors.usable``."""
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
    return usable(embeddings, zero=True).withColumn("vector", whole)


def _partial(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products by slice of the dimensions: (slice, query, candidate), exact integers."""
    bounds = [np.abs(x).max(initial=0) for x in (queries, candidates)]
    if bounds[0] * bounds[1] * max(1, queries.shape[1]) >= 2**53:
        queries, candidates = queries.astype(np.int64), candidates.astype(np.int64)
    cuts = np.linspace(0, queries.shape[1], SLICES + 1).astype(int)
    return np.stack([queries[:, a:b] @ candidates[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)])


def _slice_norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norm of every vector in every slice: (vector, slice)."""
    cuts = np.linspace(0, vectors.shape[1], SLICES + 1).astype(int)
    return np.stack([np.linalg.norm(vectors[:, a:b], axis=1) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)


class _Best:
    """The k best candidates so far of some queries, and for each query a cutoff they all reach."""

    def __init__(self, k: int):
        self.k, self.parts = k, []
        self.vectors = self.entries = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((np.asarray(rows["vec_id"]), matrix(pa.chunked_array([rows["vector"]])),
                           np.asarray(rows["cutoff"].fill_null(NONE))))

    def _begin(self) -> None:
        self.ids, self.vectors, self.cutoff = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.norms = _slice_norms(self.vectors)
        self.entries = np.empty((3, 0), dtype=np.int64)  # query's place, vec_id, score
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def score(self, rows: pa.RecordBatch) -> None:
        """Take in candidates that no query has met yet."""
        if not self.parts:
            return
        if self.vectors is None:
            self._begin()
        for at in range(0, len(rows), CHUNK[1]):
            part = rows.slice(at, CHUNK[1])
            ids, vectors = np.asarray(part["vec_id"]), matrix(pa.chunked_array([part["vector"]]))
            # No score is above the sum of the products of norms by slice; a margin covers rounding.
            bound = self.norms @ _slice_norms(vectors).max(axis=0) * (1 + 1e-9) + 1
            for queries in np.array_split(places := np.flatnonzero(bound >= self.cutoff),
                                          max(1, -(-len(places) // CHUNK[0]))):
                if len(queries):
                    self._score(queries, ids, vectors)

    def _score(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        partial = _partial(self.vectors[queries], vectors)
        own = ids[None, :] == self.ids[queries][:, None]
        fresh = np.flatnonzero(self.cutoff[queries] == NONE)
        if len(fresh) and len(ids) > self.k:
            # The first scores that a query meets give it a cutoff: the k-th of them beside its own.
            whole = partial[:, fresh].sum(axis=0)
            whole[own[fresh]] = NONE
            self.cutoff[queries[fresh]] = np.partition(whole, -self.k, axis=1)[:, -self.k]
        # A whole score that reaches the cutoff has a slice that reaches its share of it.
        reached = partial.max(axis=0) >= -(-self.cutoff[queries] // SLICES)[:, None]
        row, column = np.nonzero(reached & ~own)
        whole = partial[:, row, column].sum(axis=0).astype(np.int64)
        found = whole >= self.cutoff[queries][row]
        self.waiting.append(np.stack([queries[row[found]], ids[column[found]], whole[found]]))
        self.held += int(found.sum())
        if self.held > 4 * self.k * len(self.ids) + CHUNK[0] * CHUNK[1]:
            self._settle()

    def _settle(self) -> None:
        """Keep the k best entries of each query, and raise the cutoffs to the k-th."""
        query, ids, score = np.concatenate([self.entries, *self.waiting], axis=1)
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.entries, self.waiting, self.held = np.stack([query[kept], ids[kept], score[kept]]), [], 0
        last = rank == self.k - 1
        self.cutoff[query[last]] = np.maximum(self.cutoff[query[last]], score[last])

    def result(self) -> pa.RecordBatch | None:
        if self.vectors is None:
            return None
        self._settle()
        query, ids, score = self.entries
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids), pa.array(score)],
                                          names=["query_id", "vec_id", "score"])


def _searched(queries: DataFrame, candidates: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): what each group of candidates adds to each query's best.

    ``queries`` are sent to the groups that they list, candidates to all blocks of queries. In a
    task the queries of a block come first, then the group's candidates, long vectors first, which
    are read once and not held.
    """
    columns = ("block", "group", "side", "vec_id", "vector", "cutoff", "norm")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select(block.alias("block"), F.explode("groups").alias("group"), F.lit(0).alias("side"), "vec_id",
                           "vector", "cutoff", F.lit(0.0).alias("norm"))
    given = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "group",
                              F.lit(1).alias("side"), "vec_id", "vector", F.lit(None).cast("long").alias("cutoff"),
                              F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("norm"))
    rows = asked.select(*columns).unionByName(given.select(*columns)).repartition("block", "group")
    rows = rows.sortWithinPartitions("block", "group", "side", F.desc("norm"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, _Best(k)
        for batch in batches:
            keys = np.stack([np.asarray(batch[c]) for c in ("block", "group", "side")])
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0).any(axis=0)]))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                if (here := tuple(keys[:2, a])) != at:
                    if (found := best.result()) is not None:
                        yield found
                    at, best = here, _Best(k)
                (best.score if keys[2, a] else best.add)(batch.slice(a, b - a))
        if (found := best.result()) is not None:
            yield found

    return rows.mapInArrow(work, SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    ``vectors`` and ``queries`` hold vec_id and vector, integers as doubles; a query's own vec_id
    is no candidate. Candidates are dealt over a fixed number of groups, so what is sent grows with
    the queries. A score is the sum of four, one for each slice of the dimensions.

    1. One group gives its local list of each query; the k-th score in it is a safe cutoff.
    2. The cutoff goes to the other groups with the queries. A score that reaches it has a slice
       that reaches a fourth of it: only entries with such a slice are collected, and candidates
       whose norms by slice rule the cutoff out are passed over.
    3. For those entries alone the whole score is resolved, exactly; those that reach the cutoff,
       which rises on the way, compete with the list of the first phase.

    Every pair is scored once. Ties go to the smaller vec_id; a query with k candidates or fewer
    returns them all. The scores have to fit a long. No group sends more than k rows per query, and
    a task holds 16,384 queries and the scores of 64 of them with 4,096 candidates.
    """
    vectors = stored(vectors, "vectors")
    queries = stored(queries, "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = vectors.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(GROUPS)).cast("int"))
    first = queries.withColumn("groups", F.array(F.lit(0))).withColumn("cutoff", F.lit(None).cast("long"))
    local = stored(_searched(first, dealt.where("group = 0"), k, blocks), "local")
    cutoffs = ranked(local, k, False).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    sent = queries.join(stored(cutoffs, "cutoffs"), "vec_id", "left").withColumn(
        "groups", F.sequence(F.lit(1), F.lit(GROUPS - 1)))
    found = _searched(sent, dealt.where("group > 0"), k, blocks)
    return ranked(local.unionByName(found), k, False)
