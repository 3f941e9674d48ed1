"""Differences between two versions of a table, and changes applied to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATED, CHANGED, REMOVED = "created", "changed", "removed"

#: Columns of stored changes: the names of the columns a change sets, and whether it closed the row.
COLUMNS, CLOSED = "__columns", "__closed"


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key, change, columns)`` of the rows that differ; ``columns`` names the changed ones.

    A column that one version lacks counts as empty there. One whose type changed is named for
    every row that has it filled in either version. Keys are unique in each version.
    """
    retyped = {
        c for c in old.columns
        if c in new.columns and c not in key and old.schema[c].dataType != new.schema[c].dataType
    }
    values = list(dict.fromkeys(c for c in old.columns + new.columns if c not in key))

    def side(rows, name):
        cells = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).alias(c) for c in values]
        return rows.select(*key, F.struct(F.lit(True).alias("__here"), *cells).alias(name))

    joined = side(old, "o").join(side(new, "n"), list(key), "full_outer")
    changed = [
        F.when(
            F.col(f"o.`{c}`").isNotNull() | F.col(f"n.`{c}`").isNotNull() if c in retyped
            else ~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")),
            F.lit(c),
        )
        for c in values
    ]
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    return (
        joined.select(
            *key,
            F.when(F.col("o").isNull(), CREATED).when(F.col("n").isNull(), REMOVED)
            .otherwise(CHANGED).alias("change"),
            F.when(both, F.concat_ws(",", *changed)).otherwise("").alias("columns"),
        )
        .filter((F.col("change") != CHANGED) | (F.col("columns") != ""))
    )


def apply_changes(
    base: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    removed: str | None = None,
) -> DataFrame:
    """``base`` with the changes of each key; ``removed`` marks changes that close a row.

    ``order`` columns belong to the changes alone; any change comes after the base row. A change
    sets the columns that ``changes`` has; columns that only the base has keep what they hold. A
    key whose last change closes it is gone, and a row that a later change opens again starts
    anew, with the other columns empty.

    Changes of differing columns say in ``COLUMNS`` which ones they set; each column then takes
    its cell from the last change that sets it. ``CLOSED`` marks changes before which the row was
    closed within the same batch.
    """
    if COLUMNS in changes.columns:
        return _apply_mixed(base, changes, key, order, removed)
    partial = [c for c in base.columns if c not in changes.columns]
    set_by = [c for c in base.columns if c not in partial and c not in key]
    ranks = [f"__rank{i}" for i in range(len(order))]
    gone = F.coalesce(F.col(f"`{removed}`"), F.lit(False)) if removed else F.lit(False)
    newer = changes.select(
        *key, F.struct(*[F.col(f"`{c}`") for c in set_by], gone.alias("__gone")).alias("__new"),
        *[F.col(f"`{c}`").alias(r) for c, r in zip(order, ranks, strict=True)],
    )
    last = newer.groupBy(*key).agg(
        F.max_by("__new", F.struct(*ranks)).alias("__new"),
        F.bool_or("__new.__gone").alias("__closed"),
    )
    older = base.select(*key, F.struct(F.lit(True).alias("__here"), *[
        F.col(f"`{c}`") for c in base.columns if c not in key]).alias("__old"))
    joined = older.join(last, list(key), "full_outer")
    changed = F.col("__new").isNotNull()
    cells = {
        c: F.when(changed, F.col(f"__new.`{c}`")).otherwise(F.col(f"__old.`{c}`")) for c in set_by
    }
    cells |= {c: F.when(~F.coalesce("__closed", F.lit(False)), F.col(f"__old.`{c}`"))
              for c in partial if c not in key}
    left = joined.filter(~F.coalesce("__new.__gone", F.lit(False)))
    return left.select(*[cells[c].alias(c) if c in cells else F.col(f"`{c}`") for c in base.columns])


def _apply_mixed(base, changes, key, order, removed) -> DataFrame:
    """``apply_changes`` for changes that set different columns: one aggregation, one join."""
    rank = F.struct(*[F.col(f"`{c}`") for c in order])
    gone = F.coalesce(F.col(f"`{removed}`"), F.lit(False)) if removed else F.lit(False)
    closed = F.coalesce(CLOSED, F.lit(False)) if CLOSED in changes.columns else F.lit(False)
    cells = [c for c in base.columns if c not in key]
    held = {c: f"__cell{i}" for i, c in enumerate(cells) if c in changes.columns}
    aggregates = [F.max(F.when(gone | closed, rank)).alias("__shut"), F.max_by(gone, rank).alias("__gone")]
    for c, name in held.items():
        sets = F.when(F.coalesce(F.array_contains(COLUMNS, c), F.lit(True)) & ~gone, rank)
        aggregates += [F.max(sets).alias(f"{name}_at"), F.max_by(F.col(f"`{c}`"), sets).alias(name)]
    last = changes.groupBy(*key).agg(*aggregates).withColumn("__changed", F.lit(True))
    older = base.select(*key, F.struct(F.lit(True).alias("__here"), *[F.col(f"`{c}`") for c in cells]).alias("__old"))
    joined = older.join(last, list(key), "full_outer").filter(~F.coalesce("__gone", F.lit(False)))
    out = {}
    for c in cells:
        before = F.when(F.col("__shut").isNull(), F.col(f"__old.`{c}`"))
        out[c] = before
        if c in held:
            at = F.col(f"{held[c]}_at")
            newest = at.isNotNull() & F.coalesce(at >= F.col("__shut"), F.lit(True))
            out[c] = F.when(newest, F.col(held[c])).otherwise(before)
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in base.columns])
