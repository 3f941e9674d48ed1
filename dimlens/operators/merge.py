"""Merging resources that share a key into one wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.functions.cells import empty_to_null

RESOURCE, ROW = "__resource", "__row"

OVERWRITE, TRANSLATION, STRICT = "overwrite", "translation", "strict"


def merge(
    frames: Sequence[DataFrame],
    key: Sequence[str],
    mode: str = OVERWRITE,
    row_orders: Sequence[Column | None] | None = None,
    places: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Full outer merge of ``frames`` on ``key``; per column the last frame that has it wins.

    ``overwrite`` lets an empty cell of a later frame win, ``translation`` takes a cell only
    where it is filled, ``strict`` fails on two frames that disagree. One frame alone is
    returned untouched; two or more also collapse the rows of a key.

    The merge is a union and one aggregation: each frame shuffles once, combined before the
    shuffle, however many frames there are, and a filter on the key reaches every scan. A key gives
    one row, also where a frame repeats it: without an order of rows, a column that one frame alone
    has takes its largest cell, any other column one of the last frame's cells.

    A frame may hold several files, told apart by the places in its column ``RESOURCE``; ``places``
    then lists those of each frame, a later place winning.
    """
    places = places or [[place] for place in range(len(frames))]
    if len(frames) == 1 and len(places[0]) == 1:
        return frames[0].drop(ROW, RESOURCE)
    tagged, values, orders = _tag(frames, key, row_orders, places)
    cells = []
    for name, holders in values.items():
        cell = F.col(f"`{name}`")
        everywhere = len(holders) == sum(map(len, places))
        present = F.lit(True) if everywhere else F.col(RESOURCE).isin(*holders)
        if mode == TRANSLATION:
            present = filled(cell, tagged.schema[name].dataType)
        rank = F.struct(RESOURCE, *orders) if orders else F.col(RESOURCE)
        alone = len(holders) == 1 and not orders and isinstance(tagged.schema[name].dataType, T.AtomicType)
        last = F.max(F.when(present, cell)) if alone else F.max_by(cell, F.when(present, rank))
        if mode == STRICT:
            message = F.lit(f"resources disagree on {name}")
            differ = _disagree(cell, present, tagged.schema[name].dataType)
            last = F.when(differ, F.raise_error(message)).otherwise(last)
        cells.append(last.alias(name))
    if not cells:
        return tagged.select(*key).distinct()
    return tagged.groupBy(*key).agg(*cells)


def conflicts(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys on which frames disagree: the key and the names of the columns concerned."""
    tagged, values, _ = _tag(frames, key, None)
    flags = {}
    for name, holders in values.items():
        if len(holders) > 1:
            present = F.col(RESOURCE).isin(*holders)
            flags[name] = _disagree(F.col(f"`{name}`"), present, tagged.schema[name].dataType)
    if not flags:
        return tagged.select(*key, F.lit("").alias("columns")).filter(F.lit(False))
    checked = tagged.groupBy(*key).agg(*[flag.alias(name) for name, flag in flags.items()])
    names = F.concat_ws(",", *[F.when(F.col(f"`{n}`"), F.lit(n)) for n in flags])
    return checked.select(*key, names.alias("columns")).filter(F.col("columns") != "")


def last_rows(
    rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The row of each key that comes last in ``order``, combined before the shuffle."""
    values = [F.col(f"`{c}`") for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("__last")).select(*key, "__last.*")


def _tag(frames, key, row_orders, places=None):
    """One table of all frames, each row marked with the place of its frame."""
    row_orders = row_orders or [None] * len(frames)
    places = places or [[place] for place in range(len(frames))]
    # Rows are compared within a frame only, so each frame orders by a column of its own type.
    orders = [None if o is None else f"{ROW}{place}" for place, o in enumerate(row_orders)]
    frames = [
        frame if order is None else frame.withColumn(name, order)
        for frame, order, name in zip(frames, row_orders, orders, strict=True)
    ]
    frames = aligned([frame.drop(ROW) for frame in frames])
    values: dict[str, list[int]] = {}
    for own, frame in zip(places, frames, strict=True):
        for name in frame.columns:
            if name not in key and name not in orders and name != RESOURCE:
                values.setdefault(name, []).extend(own)
    tagged = None
    for own, frame in zip(places, frames, strict=True):
        if len(own) == 1:
            frame = frame.withColumn(RESOURCE, F.lit(own[0]))
        tagged = frame if tagged is None else tagged.unionByName(frame, allowMissingColumns=True)
    return tagged, values, [name for name in orders if name]


def aligned(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Cast columns whose types differ: numbers widen by themselves, the rest becomes text."""
    types: dict[str, set[T.DataType]] = {}
    for frame in frames:
        for column in frame.schema:
            if column.name != RESOURCE and not isinstance(column.dataType, T.NullType):
                types.setdefault(column.name, set()).add(column.dataType)
    text = {
        name
        for name, found in types.items()
        if len(found) > 1 and not all(isinstance(t, T.NumericType) for t in found)
    }
    return [
        frame.withColumns({c: F.col(f"`{c}`").cast("string") for c in frame.columns if c in text})
        if text & set(frame.columns)
        else frame
        for frame in frames
    ]


def filled(cell: Column, kind: T.DataType) -> Column:
    """The cell holds something: not null and not empty text."""
    return cell.isNotNull() & (cell != "") if isinstance(kind, T.StringType) else cell.isNotNull()


def _disagree(cell: Column, present: Column, kind: T.DataType) -> Column:
    """Aggregate: present cells of a key are not all equal; an empty cell is a value too."""
    if isinstance(kind, T.StringType):
        cell = empty_to_null(cell)
    held = F.when(present, cell)
    empty = F.max(present & cell.isNull())
    return F.coalesce(F.min(held) != F.max(held), F.lit(False)) | (
        empty & F.max(held).isNotNull()
    )
