"""Versions compared by digests: only parts of a table whose digests differ are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimlens.operators.versions import version_diff

ROWS, DIGESTS = "rows", "digests"
BUCKET, LEAF = "__bucket", "__leaf"


def _places(key: Sequence[str], buckets: int, leaves: int) -> dict[str, Column]:
    """A key's bucket, and its leaf inside the bucket."""
    place = F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in key]), F.lit(buckets * leaves))
    return {BUCKET: F.floor(place / leaves).cast("int"), LEAF: F.pmod(place, F.lit(leaves)).cast("int")}


def store_with_digests(
    rows: DataFrame, key: Sequence[str], path: str, buckets: int = 64, leaves: int = 256
) -> None:
    """Write a version below ``path``: its rows in folders by bucket, and the digests of its leaves.

    A row's digest is two hashes of all its cells by column name; a leaf's is their sums, which do
    not depend on an order, and the number of rows. Two levels of digests, buckets of leaves, are
    few whatever the table: ``buckets * leaves`` rows at most.
    """
    placed = rows.withColumns(_places(key, buckets, leaves))
    # Rows of a bucket are spread by leaf, so that no bucket is one task's work.
    placed.repartition(BUCKET, LEAF).sortWithinPartitions(BUCKET, LEAF).write.partitionBy(BUCKET).parquet(f"{path}/{ROWS}")
    named = [c for c in sorted(rows.columns)]
    cells = [x for c in named for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    hashes = {"first": F.xxhash64(*cells), "second": F.xxhash64(F.lit("second"), *cells)}
    stored = rows.sparkSession.read.parquet(f"{path}/{ROWS}")
    stored.groupBy(BUCKET, LEAF).agg(
        F.count("*").alias("n"), *[F.sum(h.cast("decimal(38,0)")).alias(n) for n, h in hashes.items()]
    ).withColumns({"buckets": F.lit(buckets), "leaves": F.lit(leaves)}).write.parquet(f"{path}/{DIGESTS}")


def differing_leaves(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``(__bucket, __leaf)`` whose digests differ between two stored versions."""
    sides = {n: spark.read.parquet(f"{p}/{DIGESTS}") for n, p in (("o", old), ("n", new))}
    content = {n: F.struct("n", "first", "second", "buckets", "leaves").alias(n) for n in sides}
    met = sides["o"].select(BUCKET, LEAF, content["o"]).join(
        sides["n"].select(BUCKET, LEAF, content["n"]), [BUCKET, LEAF], "full_outer")
    shape = F.coalesce(F.col("o.buckets") == F.col("n.buckets"), F.lit(True)) & F.coalesce(
        F.col("o.leaves") == F.col("n.leaves"), F.lit(True))
    differ = F.when(~shape, F.raise_error(F.lit("versions were stored in buckets of different numbers")))
    return met.filter(F.coalesce(differ, ~F.col("o").eqNullSafe(F.col("n")))).select(BUCKET, LEAF)


def digest_diff(spark: SparkSession, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """What ``version_diff`` finds between two stored versions, from the leaves that differ alone.

    Leaves to read are as few as digests, so they are known before the rows are: folders of equal
    buckets are not read, rows of equal leaves not shuffled. A column that only one version has
    changes every digest, and then all rows are compared.
    """
    leaves = differing_leaves(spark, old, new).collect()  # bounded by the number of digests
    by_bucket: dict[int, list[int]] = {}
    for row in leaves:
        by_bucket.setdefault(row[BUCKET], []).append(row[LEAF])
    listed = spark.createDataFrame([(b, x) for b, found in by_bucket.items() for x in found], f"{BUCKET} int, {LEAF} int")

    def side(path: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{ROWS}")
        rows = rows.filter(F.col(BUCKET).isin(*by_bucket)) if by_bucket else rows.limit(0)
        return rows.join(F.broadcast(listed), [BUCKET, LEAF], "left_semi").drop(BUCKET, LEAF)

    return version_diff(side(old), side(new), key)
