"""Many versions of a table as one: rows with the versions they hold in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimlens.operators.merge import aligned

#: The first version a row holds in, and the first one after that; the latter is null up to now.
SINCE, UNTIL = "valid_from", "valid_until"


def version_history(versions: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """``(key…, cells…, valid_from, valid_until)`` of versions 0, 1, …, given in their order.

    A row that neighbouring versions share is one row; one that goes and comes back is two. A
    column that a version lacks is empty there; columns whose types differ become text, as in a
    merge. Keys are unique in each version. Versions meet in one shuffle by key, and a key has at
    most one row per version, however many there are.
    """
    tagged = None
    for number, rows in enumerate(aligned(versions)):
        rows = rows.withColumn("__version", F.lit(number))
        tagged = rows if tagged is None else tagged.unionByName(rows, allowMissingColumns=True)
    cells = [c for c in tagged.columns if c not in key and c != "__version"]
    content = F.struct(F.lit(0).alias("same"), *[F.col(f"`{c}`") for c in cells])
    held = tagged.groupBy(*[f"`{k}`" for k in key]).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__version").alias("version"), content.alias("row")))).alias("__held"))
    # A row begins where the version before lacks the key or holds another row.
    begins = held.withColumn("__begins", F.expr("""filter(sequence(0, size(__held) - 1), i -> i = 0
        OR get(__held, i - 1).version <> get(__held, i).version - 1 OR NOT get(__held, i - 1).row <=> get(__held, i).row)"""))
    spans = begins.select(*key, F.explode(F.expr("""transform(__begins, (b, j) -> struct(get(__held, b) AS begin,
        get(__held, coalesce(get(__begins, j + 1), size(__held)) - 1).version + 1 AS until))""")).alias("__span"))
    until = F.col("__span.until")
    return spans.select(
        *[F.col(f"`{k}`") for k in key], *[F.col(f"__span.begin.row.`{c}`") for c in cells],
        F.col("__span.begin.version").alias(SINCE), F.when(until < len(versions), until).alias(UNTIL))


def with_version(history: DataFrame, rows: DataFrame, number: int, key: Sequence[str]) -> DataFrame:
    """The history with the version of the given number, the next one.

    Only rows that held up to now meet the new version; rows that ended are handed on as they are.
    """
    cells = [c for c in history.columns if c not in key and c not in (SINCE, UNTIL)]
    lacking = [c for c in cells if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast(history.schema[c].dataType) for c in lacking})
    added = [c for c in rows.columns if c not in key and c not in cells]
    history = history.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in added})
    cells += added
    content = [F.col(f"`{c}`") for c in cells]
    held = history.filter(F.col(UNTIL).isNull()).select(
        *key, F.struct(F.lit(0).alias("__here"), *content).alias("__old"), SINCE)
    new = rows.select(*key, F.struct(F.lit(0).alias("__here"), *content).alias("__new"))
    met = held.join(new, list(key), "full_outer")
    same = F.col("__old").eqNullSafe(F.col("__new"))
    before = F.when(F.col("__old").isNotNull(), F.struct(
        F.col("__old").alias("row"), F.col(SINCE).alias("since"), F.when(~same, F.lit(number)).alias("until")))
    after = F.when(F.col("__new").isNotNull() & ~same, F.struct(
        F.col("__new").alias("row"), F.lit(number).alias("since"), F.lit(None).cast("int").alias("until")))
    current = met.select(*key, F.explode(F.array_compact(F.array(before, after))).alias("e")).select(
        *key, *[F.col(f"e.row.`{c}`") for c in cells], F.col("e.since").alias(SINCE), F.col("e.until").alias(UNTIL))
    ended = history.filter(F.col(UNTIL).isNotNull())
    return ended.select(*current.columns).unionByName(current)


def as_of(history: DataFrame, number: int) -> DataFrame:
    """The rows of one version. The condition reaches the scan of a stored history."""
    held = (F.col(SINCE) <= number) & (F.col(UNTIL).isNull() | (F.col(UNTIL) > number))
    return history.filter(held).drop(SINCE, UNTIL)


def history_between(history: DataFrame, first: int, last: int) -> DataFrame:
    """Rows that began or ended after version ``first``, up to ``last``, with what happened in ``change``."""
    began = (F.col(SINCE) > first) & (F.col(SINCE) <= last)
    ended = (F.col(UNTIL) > first) & (F.col(UNTIL) <= last)
    events = F.array_compact(F.array(
        F.when(began, F.struct(F.lit("began").alias("change"), F.col(SINCE).alias("version"))),
        F.when(ended, F.struct(F.lit("ended").alias("change"), F.col(UNTIL).alias("version")))))
    kept = [c for c in history.columns if c not in (SINCE, UNTIL)]
    return history.filter(began | ended).select(*[F.col(f"`{c}`") for c in kept], F.explode(events).alias("e")).select(
        *[F.col(f"`{c}`") for c in kept], "e.*")
