"""Keys and columns that a version renamed, told by what they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(rows: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(names…, column, value)``: one row per filled cell, the value hashed with its column."""
    cells = [
        F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""), F.struct(
            F.lit(i).alias("column"), F.xxhash64(F.lit(c), F.col(f"`{c}`").cast("string")).alias("value")))
        for i, c in enumerate(columns)]
    return rows.select(*names, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*names, "c.*")


def key_renames(
    old: DataFrame, new: DataFrame, key: str, least: float = 0.5, rare: int = 16
) -> DataFrame:
    """``(old_key, new_key, agreement)`` of keys that were removed and came back under another name.

    Removed and created keys are compared by the cells of the columns both versions have. A cell
    weighs the more the fewer of these keys hold its value: one over the binary logarithm of one plus
    their number in either version. ``agreement`` is the weight of equal cells over that of all cells either key fills, from
    0 to 1, and at least ``least``. Two keys are a pair if each agrees best with the other; of equally
    good ones the smaller key counts.

    Only keys that share a value which at most ``rare`` removed and ``rare`` created keys hold can be
    a pair: what many keys hold names none of them. Keys meet by such values, so no group of pairs
    is larger than that. Versions are compared by key first, and unchanged keys never reach the
    comparison.
    """
    columns = [c for c in old.columns if c in new.columns and c != key]
    by_key = [F.col(f"`{key}`").alias("__name"), *[F.col(f"`{c}`") for c in columns]]
    removed = old.join(new.select(f"`{key}`"), key, "left_anti").select(*by_key)
    created = new.join(old.select(f"`{key}`"), key, "left_anti").select(*by_key)
    sides = _cells(removed, ["__name"], columns).withColumn("side", F.lit(0)).unionByName(
        _cells(created, ["__name"], columns).withColumn("side", F.lit(1)))
    held = sides.groupBy("value").agg(F.count_if(F.col("side") == 0).alias("olds"), F.count_if(F.col("side") == 1).alias("news"))
    weighed = held.withColumn("weight", 1 / F.log2(F.greatest("olds", "news") + 1))
    cells = sides.join(weighed, "value")
    sums = cells.groupBy("side", "__name").agg(F.sum("weight").alias("whole"))
    meeting = cells.filter((F.col("olds") <= rare) & (F.col("news") <= rare) & (F.col("olds") > 0) & (F.col("news") > 0))
    left = meeting.filter("side = 0").select("value", F.col("__name").alias("old_key"))
    right = meeting.filter("side = 1").select("value", F.col("__name").alias("new_key"))
    pairs = left.join(right, "value").select("old_key", "new_key").distinct()
    # All equal cells of a pair count, frequent values too.
    ours = cells.filter("side = 0").select(F.col("__name").alias("old_key"), "column", "value", "weight")
    theirs = cells.filter("side = 1").select(F.col("__name").alias("new_key"), "column", "value")
    equal = pairs.join(ours, "old_key").join(theirs, ["new_key", "column", "value"])
    shared = equal.groupBy("old_key", "new_key").agg(F.sum("weight").alias("shared"))
    scored = shared.join(sums.filter("side = 0").select(F.col("__name").alias("old_key"), F.col("whole").alias("a")), "old_key").join(
        sums.filter("side = 1").select(F.col("__name").alias("new_key"), F.col("whole").alias("b")), "new_key")
    agreement = F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))
    return mutual_best(scored.withColumn("agreement", agreement).filter(F.col("agreement") >= least),
                       "old_key", "new_key", "agreement")


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """``(left, right, score)`` of the pairs that are best for both, ties to the smaller name."""
    # Sums of floats differ in their last digits from order to order.
    rows = pairs.select(left, right, F.round(score, 9).alias(score))

    def best(own: str, other: str) -> DataFrame:
        first = F.min(F.struct((-F.col(score)).alias("__least"), F.col(other).alias(other)))
        return rows.groupBy(own).agg(first.alias("__best")).select(own, F.col(f"__best.{other}").alias(other))

    return rows.join(best(left, right), [left, right]).join(best(right, left), [left, right])


def column_renames(old: DataFrame, new: DataFrame, key: Sequence[str], least: float = 0.5) -> DataFrame:
    """``(old_column, new_column, agreement)`` of columns that came back under another name.

    Columns that one version alone has are compared on the keys of both: ``agreement`` is the share
    of equal cells among those that either column fills. Versions meet in one join, whose rows shrink
    to one row of counts; two columns are a pair if each agrees best with the other.
    """
    gone = [c for c in old.columns if c not in new.columns]
    came = [c for c in new.columns if c not in old.columns]
    spark = old.sparkSession
    if not gone or not came:
        return spark.createDataFrame([], "old_column string, new_column string, agreement double")

    def side(rows: DataFrame, columns: Sequence[str], mark: str) -> DataFrame:
        cells = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"{mark}{i}") for i, c in enumerate(columns)]
        return rows.select(*[f"`{k}`" for k in key], *cells)

    met = side(old, gone, "__o").join(side(new, came, "__n"), list(key))
    counts: list[Column] = []
    for i in range(len(gone)):
        for j in range(len(came)):
            a, b = F.col(f"__o{i}"), F.col(f"__n{j}")
            counts += [F.count_if(a == b).alias(f"same{i}_{j}"),
                       F.count_if(a.isNotNull() | b.isNotNull()).alias(f"any{i}_{j}")]
    entries = F.array(*[
        F.struct(F.lit(o).alias("old_column"), F.lit(n).alias("new_column"),
                 F.try_divide(F.col(f"same{i}_{j}"), F.col(f"any{i}_{j}")).cast("double").alias("agreement"))
        for i, o in enumerate(gone) for j, n in enumerate(came)])
    pairs = met.agg(*counts).select(F.explode(entries).alias("e")).select("e.*")
    return mutual_best(pairs.filter(F.col("agreement") >= least), "old_column", "new_column", "agreement")


def versions_renamed(old: DataFrame, new: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """The old version with its renamed keys under their new names, for ``version_diff``."""
    given = renames.select(F.col("old_key").alias("__from"), F.col("new_key").alias("__to"))
    met = old.join(given, F.col(f"`{key}`") == F.col("__from"), "left")
    named = {c: F.col(f"`{c}`") for c in old.columns} | {key: F.coalesce("__to", F.col(f"`{key}`"))}
    return met.select(*[named[c].alias(c) for c in old.columns])
