"""Vectors of an embeddings table, and searches in blocks of queries against blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, vector): the vectors that take part, as doubles.

    Rows without an id, null vectors and those with a null or non-finite component take no part,
    nor do zero vectors unless ``zero``. Vectors have to be of one length: that of most rows, the
    larger of equally frequent ones; others take no part. Of rows with the same id the vector that
    sorts first stands for all.
    """
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = "forall(vector, x -> x is not null and abs(x) < double('infinity'))"
    vectors = vectors.where(f"vec_id is not null and vector is not null and {finite}")
    if not zero:
        vectors = vectors.where("exists(vector, x -> x <> 0)")
    sizes = vectors.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c"))
    most = sizes.orderBy(F.desc("c"), F.desc("n")).first()
    vectors = vectors.where(F.size("vector") == (most["n"] if most else 0))
    return vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = np.asarray(vectors.combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def in_blocks(queries: DataFrame, candidates: DataFrame, parts: dict[int, tuple[int, int]],
              search: Callable, schema: str, block: tuple[int, int]) -> DataFrame:
    """``search(queries, candidates)`` for every query block and candidate block of a part.

    Both frames have vec_id, vector and part; ``parts`` gives how many queries and candidates a
    part holds. Rows are dealt over blocks of about ``block`` rows by a hash of their id, so a part
    of any size is split evenly, and each row is sent to every block of the other side. ``search``
    gets and returns Arrow tables.
    """
    def dealt(frame: DataFrame, side: int, own: str, other: str) -> DataFrame:
        numbers = [{p: max(1, -(-n[s] // block[s])) for p, n in parts.items()} for s in (side, 1 - side)]
        count, copies = (F.create_map(*(F.lit(x) for i in d.items() for x in i))[F.col("part")]
                         for d in numbers)
        return frame.withColumn(own, F.pmod(F.xxhash64("vec_id"), count).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), copies - 1)))

    if not parts:
        return queries.sparkSession.createDataFrame([], schema)
    keys = ["part", "query_block", "block"]
    left = dealt(queries, 0, "query_block", "block").groupBy(*keys)
    right = dealt(candidates, 1, "block", "query_block").groupBy(*keys)
    return left.cogroup(right).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best rows of each query_id, ties to the smaller vec_id, with their rank from 1."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    window = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, best first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
