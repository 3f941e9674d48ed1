"""Cell normalisation and caller-supplied column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.functions.cells import empty_to_null, parse_number_prefix

# Fixed value: text taken for a number consists of these characters; a sign is not among them.
# It also has to begin like a number.
NUMBER_TEXT = r"^\s*(?=\.?\d)[0-9.,]+\s*$"


def apply_parsers(
    rows: DataFrame, parsers: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Replace columns by what their parser makes of them; a ``pandas_udf`` is a parser too."""
    known = {name: parser for name, parser in parsers.items() if name in rows.columns}
    return rows.withColumns({n: parser(F.col(f"`{n}`")) for n, parser in known.items()})


def numeric_text_columns(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns, or columns of text arrays, in which every filled cell is a number.

    One aggregation over the data, which returns one row.
    """
    tests = []
    for name in columns:
        cell = F.col(f"`{name}`")
        if isinstance(rows.schema[name].dataType, T.ArrayType):
            fits, fills = F.forall(cell, _fits), F.exists(cell, _fills)
        else:
            fits, fills = _fits(cell), _fills(cell)
        tests.append((F.bool_and(fits) & F.bool_or(fills)).alias(name))
    if not tests:
        return []
    found = rows.agg(*tests).first()
    return [name for name in columns if found[name]]


def normalize_cells(
    rows: DataFrame,
    parsers: Mapping[str, Callable[[Column], Column]] | None = None,
    numeric: Sequence[str] | None = None,
) -> DataFrame:
    """Empty text to null and number text to numbers, also inside arrays.

    A column has one type: it becomes numeric when all its filled cells are numbers. ``numeric``
    names those columns when the caller knows them, which saves the pass over the data. A
    column with a parser is left to the parser.
    """
    parsers = dict(parsers or {})
    text = [f.name for f in rows.schema if f.name not in parsers and _holds_text(f.dataType)]
    if numeric is None:
        numeric = numeric_text_columns(rows, text)
    cells = []
    for column in rows.schema:
        cell = F.col(f"`{column.name}`")
        if column.name in text:
            normal = _as_number if column.name in numeric else empty_to_null
            array = isinstance(column.dataType, T.ArrayType)
            cell = F.transform(cell, normal) if array else normal(cell)
        cells.append(cell.alias(column.name))
    return apply_parsers(rows.select(*cells), parsers)


def _holds_text(kind: T.DataType) -> bool:
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return isinstance(kind, T.StringType)


def _fits(cell: Column) -> Column:
    return cell.rlike(NUMBER_TEXT) | ~_fills(cell)


def _fills(cell: Column) -> Column:
    return cell.isNotNull() & (cell != "")


def _as_number(cell: Column) -> Column:
    return F.when(cell.rlike(NUMBER_TEXT), parse_number_prefix(cell))
