"""Ordering of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.errors import QueryError

# The accepted directions.
ASCENDING = ("asc", 1)
DESCENDING = ("desc", -1)


def order_terms(order_by: str | Sequence[str | Mapping] | None) -> list[tuple[str, bool]]:
    """``(column, ascending)`` pairs of an ``order_by`` clause."""
    if not order_by:
        return []
    terms = []
    for term in [order_by] if isinstance(order_by, (str, Mapping)) else order_by:
        if isinstance(term, str):
            terms.append((term, True))
            continue
        if len(term) != 1:
            raise QueryError("an order_by entry names one column")
        ((name, direction),) = term.items()
        if direction not in ASCENDING + DESCENDING:
            raise QueryError(f"unknown direction {direction!r} for {name}")
        terms.append((name, direction in ASCENDING))
    return terms


def _terms(rows: DataFrame, order_by, ties: Sequence[str]) -> list[tuple[str, bool]]:
    """Sort terms on columns that the rows have, then the columns that break ties."""
    terms = [(name, up) for name, up in order_terms(order_by) if name in rows.columns]
    named = {name for name, _ in terms}
    return terms + [(name, True) for name in ties if terms and name not in named]


def _sorted(rows: DataFrame, terms: Sequence[tuple[str, bool]]) -> DataFrame:
    return rows.orderBy(*[
        F.col(f"`{name}`").asc_nulls_first() if up else F.col(f"`{name}`").desc_nulls_last()
        for name, up in terms
    ])


def order_rows(rows: DataFrame, order_by, ties: Sequence[str] = ()) -> DataFrame:
    """Sort by the selected columns of ``order_by``: nulls first ascending, last descending.

    Rows that compare equal follow the columns ``ties``. That makes the order definite, and it
    lets the range partitioning of the sort split a value that most rows share.
    """
    terms = _terms(rows, order_by, ties)
    return _sorted(rows, terms) if terms else rows


def guard_rows(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, which the caller asks for; a sorted result becomes a top-k."""
    return rows.limit(limit)


def page_rows(
    rows: DataFrame, order_by, size: int, ties: Sequence[str], after: Mapping[str, Any] | None = None
) -> DataFrame:
    """The next ``size`` rows in the order of ``order_rows``, after a given row of an earlier page.

    ``after`` holds that row's cells of the sort columns and of ``ties``, which together tell rows
    apart; without it the first page is given. A page is a condition and a top-k: no rows are
    numbered or skipped, and no page sorts the whole. What the condition says about the first sort
    column stands by itself, so that it reaches the scan.
    """
    terms = _terms(rows, order_by, ties) or [(name, True) for name in ties]
    if after is not None:
        missing = [name for name, _ in terms if name not in after]
        if missing:
            raise QueryError(f"the row to go on after has no {', '.join(missing)}")
        rows = rows.filter(_not_before(rows, *terms[0], after)).filter(_follows(rows, terms, after))
    return _sorted(rows, terms).limit(size)


def _cell_and_value(rows: DataFrame, name: str, after: Mapping[str, Any]) -> tuple[Column, Column]:
    return F.col(f"`{name}`"), F.lit(after[name]).cast(rows.schema[name].dataType)


def _not_before(rows: DataFrame, name: str, up: bool, after: Mapping[str, Any]) -> Column:
    """The cell is the given one or comes after it; nulls are first ascending, last descending."""
    cell, value = _cell_and_value(rows, name, after)
    if after[name] is None:
        return F.lit(True) if up else cell.isNull()
    return cell >= value if up else (cell <= value) | cell.isNull()


def _follows(rows: DataFrame, terms: Sequence[tuple[str, bool]], after: Mapping[str, Any]) -> Column:
    """The row comes after the given one: by the first column that differs."""
    (name, up), rest = terms[0], terms[1:]
    cell, value = _cell_and_value(rows, name, after)
    if after[name] is None:
        later, same = cell.isNotNull() if up else F.lit(False), cell.isNull()
    else:
        later, same = cell > value if up else (cell < value) | cell.isNull(), cell == value
    return later | (same & _follows(rows, rest, after)) if rest else later
