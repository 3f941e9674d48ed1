"""Conditions (``where``) as Spark columns and semi-joins.

A condition is two-valued: a comparison with a missing cell is false, and its negation true.
Spark is three-valued, but a null in a conjunction or disjunction already counts as false in a
filter; only a negation has to settle it first. Leaves therefore stay bare, so that they can be
pushed to the scan, and ``coalesce`` appears under negations alone.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.errors import QueryError
from dimlens.functions.cells import LOOSE_NUMBER, loose_number

# The operators of the condition language.
COMBINERS = ("$and", "$or", "$not", "$nor")
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")
ARRAY_OPERATORS = ("$size", "$all", "$elemMatch")
OPERATORS = COMBINERS + COMPARISONS + ARRAY_OPERATORS

_RANGE = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


@dataclass(frozen=True, eq=False)
class IdJoin:
    """A join target: ``key`` must be among the ids of a one-column DataFrame."""

    key: str
    ids: DataFrame


@dataclass(frozen=True)
class InlinedJoin:
    """A join target whose condition applies to the main rows themselves."""

    where: Mapping[str, Any]


@dataclass(frozen=True)
class Bounds:
    """Lowest and highest value a column can take, both included; None where it is open."""

    low: str | None = None
    high: str | None = None

    def within(self, other: Bounds) -> Bounds:
        """Both bounds; where text and numbers would order two of them differently, the first alone."""
        lows = [b for b in (self.low, other.low) if b is not None]
        highs = [b for b in (self.high, other.high) if b is not None]
        low, high = _span(lows) if lows else Bounds(), _span(highs) if highs else Bounds()
        return Bounds(low.high if low else lows[0], high.low if high else highs[0])


@dataclass
class Condition:
    """A compiled condition: id joins that must hold, joins that only mark rows, a filter."""

    filters: list[Column] = field(default_factory=list)
    semi_joins: list[IdJoin] = field(default_factory=list)
    marks: list[tuple[str, IdJoin]] = field(default_factory=list)

    def apply(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        for join in self.semi_joins:
            rows = semi_join(rows, join)
        for mark, join in self.marks:
            rows = mark_join(rows, join, mark)
        for column in self.filters:
            rows = rows.filter(column)
        return rows.select(*[F.col(f"`{c}`") for c in columns]) if self.marks else rows


def semi_join(rows: DataFrame, join: IdJoin) -> DataFrame:
    """Rows whose id is in the target.

    No broadcast hint: Spark broadcasts the ids when their size is below its threshold, and
    otherwise shuffles both sides, where adaptive execution splits a key that holds most rows.
    """
    ids = join.ids.toDF("__id")
    return rows.join(ids, _same_id(rows, join.key, ids, "__id"), "left_semi")


def mark_join(rows: DataFrame, join: IdJoin, mark: str) -> DataFrame:
    """Rows with a boolean column that says whether the id is in the target."""
    ids = join.ids.toDF(f"{mark}_id").filter(F.col(f"{mark}_id").isNotNull()).distinct()
    ids = ids.withColumn(mark, F.lit(True))
    joined = rows.join(ids, _same_id(rows, join.key, ids, f"{mark}_id"), "left")
    return joined.withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def _same_id(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> Column:
    """Equality of two id columns; ids of different types are compared as text."""
    left, right = F.col(f"`{key}`"), F.col(id_column)
    if rows.schema[key].dataType != ids.schema[id_column].dataType:
        return left.cast("string") == right.cast("string")
    return left == right


def referenced_fields(where: Mapping[str, Any] | None) -> list[str]:
    """Names of the columns a condition looks at, in order of appearance."""
    names: dict[str, None] = {}
    for name, operand in (where or {}).items():
        if name in COMBINERS:
            parts = [operand] if isinstance(operand, Mapping) else operand
            for part in parts:
                names.update(dict.fromkeys(referenced_fields(part)))
        else:
            names[name] = None
    return list(names)


def join_references(where: Mapping[str, Any] | None) -> set[str]:
    """Join ids that a condition mentions."""
    found = set()
    for name, operand in (where or {}).items():
        parts = operand if isinstance(operand, (list, tuple)) else [operand]
        for part in parts:
            if isinstance(part, Mapping):
                found |= join_references(part)
            elif isinstance(part, str) and part.startswith("$") and name not in COMPARISONS:
                found.add(part)
    return found


def compile_condition(
    where: Mapping[str, Any] | None,
    rows: DataFrame,
    joins: Mapping[str, IdJoin | InlinedJoin] | None = None,
    id_columns: Iterable[str] = (),
) -> Condition:
    """Compile ``where`` for ``rows``.

    ``id_columns`` name columns whose values are ids: a numeric one also takes its ids as text.
    """
    return _Compiler(rows, joins or {}, set(id_columns)).compile(where or {})


def column_bounds(
    where: Mapping[str, Any] | None, joins: Mapping[str, IdJoin | InlinedJoin] | None = None
) -> dict[str, Bounds]:
    """Bounds that a condition puts for certain on columns it compares with text."""
    found: dict[str, Bounds] = {}
    for name, operand in _conjuncts(where or {}, joins or {}):
        tests = operand if isinstance(operand, Mapping) else {"$eq": operand}
        for test, value in tests.items():
            bounds = _bounds(test, value)
            if bounds and name not in COMBINERS:
                found[name] = found.get(name, Bounds()).within(bounds)
    return found


def plain_conjuncts(
    where: Mapping[str, Any] | None,
    joins: Mapping[str, IdJoin | InlinedJoin] | None,
    columns: Iterable[str],
) -> dict[str, Any]:
    """The part of a condition that must hold and looks at one of ``columns`` alone."""
    parts = [
        {name: operand}
        for name, operand in _conjuncts(where or {}, joins or {})
        if name in set(columns) and not (isinstance(operand, str) and operand in (joins or {}))
    ]
    return {"$and": parts}


def required_id_keys(
    where: Mapping[str, Any] | None, joins: Mapping[str, IdJoin | InlinedJoin] | None
) -> set[str]:
    """Keys that a condition limits to the ids of some join for certain."""
    targets = [
        (joins or {}).get(operand)
        for _, operand in _conjuncts(where or {}, joins or {})
        if isinstance(operand, str)
    ]
    return {target.key for target in targets if isinstance(target, IdJoin)}


def required_id_joins(
    where: Mapping[str, Any] | None,
    joins: Mapping[str, IdJoin | InlinedJoin] | None,
    columns: Iterable[str],
) -> list[IdJoin]:
    """Joins with ids that must hold for certain and look at one of ``columns``."""
    targets = [
        (joins or {}).get(operand)
        for _, operand in _conjuncts(where or {}, joins or {})
        if isinstance(operand, str)
    ]
    wanted = set(columns)
    return [t for t in dict.fromkeys(targets) if isinstance(t, IdJoin) and t.key in wanted]


def _bounds(test: str, value) -> Bounds | None:
    values = list(value) if test == "$in" and isinstance(value, (list, tuple, set)) else [value]
    if not values or not all(isinstance(v, str) and v and v[0] != "$" for v in values):
        return None
    if test in ("$eq", "$in"):
        return _span(values)
    if test in ("$gt", "$gte"):
        return Bounds(low=value)
    return Bounds(high=value) if test in ("$lt", "$lte") else None


def _span(values: Sequence[str]) -> Bounds | None:
    """Bounds of a list, if they are the same whether the column holds text or numbers."""
    low, high = min(values), max(values)
    numbers = [_number(v) for v in values if _number(v) is not None]
    if numbers and (len(values) > len(numbers) or (_number(low), _number(high)) != (min(numbers), max(numbers))):
        return None
    return Bounds(low, high)


def predicate(where: Mapping[str, Any], rows: DataFrame) -> Column:
    """A condition without joins as one boolean column that is never null."""
    compiler = _Compiler(rows, {}, set())
    return F.coalesce(compiler.all_of(where), F.lit(False))


@dataclass(frozen=True)
class _Cell:
    column: Column
    type: T.DataType
    is_id: bool = False
    name: str | None = None


class _Compiler:
    def __init__(self, rows, joins, id_columns):
        self.types = {f.name: f.dataType for f in rows.schema}
        self.joins = joins
        self.id_columns = id_columns
        self.condition = Condition()

    def compile(self, where) -> Condition:
        for name, operand in _conjuncts(where, self.joins):
            join = self.join_of(operand)
            if join is not None and join.key in self.types:
                self.condition.semi_joins.append(join)
            elif self.id_table(name, operand) is not None:
                self.condition.semi_joins.append(IdJoin(name, self.id_table(name, operand)))
            else:
                self.condition.filters.append(self.entry(name, operand))
        return self.condition

    # --- structure ----------------------------------------------------------------------

    def all_of(self, where) -> Column:
        return _all([self.entry(name, operand) for name, operand in where.items()])

    def entry(self, name, operand) -> Column:
        if name in COMBINERS:
            return self.combine(name, operand, self.all_of)
        if name.startswith("$"):
            raise QueryError(f"unknown operator {name}")
        join = self.joins.get(operand) if isinstance(operand, str) else None
        if isinstance(join, InlinedJoin):
            return self.all_of(join.where)
        if join is not None:
            return self.mark(join)
        if isinstance(operand, str) and operand.startswith("$"):
            raise QueryError(f"unknown join {operand}")
        if name in self.types:
            cell = _Cell(F.col(f"`{name}`"), self.types[name], name in self.id_columns, name)
        elif "." in name:
            raise QueryError(f"dotted column name {name}")
        else:
            cell = _Cell(F.lit(None), T.NullType())
        if isinstance(operand, Mapping):
            return self.cell_condition(cell, operand)
        return self.compare(cell, "$eq", operand)

    def combine(self, name, operand, part) -> Column:
        parts = [operand] if isinstance(operand, Mapping) else list(operand)
        columns = [part(p) for p in parts]
        if name == "$and":
            return _all(columns)
        if name == "$or":
            return _any(columns)
        if name == "$not":
            return _negate(_all(columns))
        return _negate(_any(columns))

    def cell_condition(self, cell: _Cell, operand) -> Column:
        """Operators on one cell, all of which must hold."""
        columns = []
        for name, value in operand.items():
            if name in COMBINERS:
                columns.append(
                    self.combine(name, value, functools.partial(self.cell_condition, cell))
                )
            elif name in ARRAY_OPERATORS:
                columns.append(self.compare_array(cell, name, value))
            elif name in COMPARISONS:
                columns.append(self.compare(cell, name, value))
            else:
                raise QueryError(f"unknown operator {name}")
        return _all(columns)

    # --- joins --------------------------------------------------------------------------

    def join_of(self, operand) -> IdJoin | None:
        join = self.joins.get(operand) if isinstance(operand, str) else None
        return join if isinstance(join, IdJoin) else None

    def mark(self, join: IdJoin) -> Column:
        if join.key not in self.types:
            return F.lit(False)
        for mark, known in self.condition.marks:
            if known.key == join.key and known.ids is join.ids:
                return F.col(mark)
        mark = f"__mark{len(self.condition.marks)}"
        self.condition.marks.append((mark, join))
        return F.col(mark)

    def id_table(self, name, operand) -> DataFrame | None:
        """The ids of ``{name: {"$in": DataFrame}}``, which limit the rows by a semi-join."""
        if isinstance(operand, Mapping) and list(operand) == ["$in"] and name in self.types:
            return operand["$in"] if isinstance(operand["$in"], DataFrame) else None
        return None

    # --- leaves -------------------------------------------------------------------------

    def compare(self, cell: _Cell, name: str, value) -> Column:
        if name == "$ne":
            return _negate(self.compare(cell, "$eq", value))
        if name == "$nin":
            return _negate(self.compare(cell, "$in", value))
        if name == "$in":
            if isinstance(value, DataFrame):
                return self.id_member(cell, value)
            if isinstance(value, (str, Mapping)) or not isinstance(value, Iterable):
                raise QueryError("$in and $nin take a list or a DataFrame of one column")
            return self.member(cell, list(value))
        if isinstance(value, (Mapping, list, tuple, set, DataFrame)):
            raise QueryError(f"{name} takes a single value")
        if name == "$eq":
            return _equal(cell, value)
        return _ranged(cell, _RANGE[name], value)

    def member(self, cell: _Cell, values) -> Column:
        if isinstance(cell.type, T.NullType):
            return F.lit("" in values)
        members = _members(cell, values)
        listed = _listed(cell, members) if members else F.lit(False)
        return listed | _empty(cell) if "" in values else listed

    def id_member(self, cell: _Cell, ids: DataFrame) -> Column:
        """Whether the cell is among the ids of a table, of any size; empty cells never are."""
        if isinstance(cell.type, T.NullType):
            return F.lit(False)
        if cell.name is None:
            raise QueryError("elements of an array are not compared with a DataFrame")
        return self.mark(IdJoin(cell.name, ids))

    def compare_array(self, cell: _Cell, name: str, value) -> Column:
        if not isinstance(cell.type, T.ArrayType):
            raise QueryError(f"{name} needs an array column")
        if name == "$size":
            return F.size(cell.column) == F.lit(value)
        if name == "$all":
            return F.size(F.array_except(F.array(*map(F.lit, value)), cell.column)) == 0
        test = value if isinstance(value, Mapping) else {"$eq": value}
        kind = cell.type.elementType
        return F.exists(
            cell.column,
            lambda item: F.coalesce(self.cell_condition(_Cell(item, kind), test), F.lit(False)),
        )


def _conjuncts(where, joins):
    """Entries that must all hold, with ``$and`` lists and inlined joins opened up."""
    for name, operand in where.items():
        join = joins.get(operand) if isinstance(operand, str) else None
        if name == "$and":
            for part in [operand] if isinstance(operand, Mapping) else operand:
                yield from _conjuncts(part, joins)
        elif isinstance(join, InlinedJoin):
            yield from _conjuncts(join.where, {})
        else:
            yield name, operand


def _all(columns: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, columns) if columns else F.lit(True)


def _any(columns: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def _negate(column: Column) -> Column:
    return ~F.coalesce(column, F.lit(False))


def _number(value) -> int | float | None:
    """Number a literal stands for, None if it stands for none."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, str):
        return float(value) if re.match(LOOSE_NUMBER, value) else None
    return value


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def _is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _numeric(cell: _Cell) -> Column:
    if _is_text(cell.type):
        return loose_number(cell.column)
    return cell.column.cast("int") if isinstance(cell.type, T.BooleanType) else cell.column


def _empty(cell: _Cell) -> Column:
    missing = cell.column.isNull()
    return missing | (cell.column == "") if _is_text(cell.type) else missing


def _equal(cell: _Cell, value) -> Column:
    if value is None or value == "":
        return _empty(cell)
    if isinstance(cell.type, T.NullType):
        return F.lit(False)
    if isinstance(value, bool) and isinstance(cell.type, T.BooleanType):
        return cell.column == F.lit(value)
    if isinstance(value, str) and _is_text(cell.type):
        return cell.column == F.lit(value)
    if _is_date(cell.type):
        return cell.column == F.lit(value).try_cast(cell.type)
    number = _number(value)
    return F.lit(False) if number is None else _numeric(cell) == F.lit(number)


def _ranged(cell: _Cell, compare, value) -> Column:
    if value is None or isinstance(cell.type, T.NullType):
        return F.lit(False)
    if isinstance(value, str) and _is_text(cell.type):
        return (cell.column != "") & compare(cell.column, F.lit(value))
    if _is_date(cell.type):
        return compare(cell.column, F.lit(value).try_cast(cell.type))
    number = _number(value)
    if number is None:
        return F.lit(False)
    ranged = compare(_numeric(cell), F.lit(number))
    return cell.column & ranged if isinstance(cell.type, T.BooleanType) else ranged


def _listed(cell: _Cell, members: list) -> Column:
    """Membership in a list of constants; a long one goes to Spark as one text, not value by value."""
    known = (str, int, float)
    long = len(members) > 32 and cell.name is not None
    if not long or not all(type(m) in known and _sql_literal(m) for m in members):
        return cell.column.isin(*members)
    return F.expr(f"`{cell.name.replace('`', '``')}` IN ({','.join(map(_sql_literal, members))})")


def _sql_literal(value: str | int | float) -> str | None:
    """A constant as SQL text, None for numbers that have no such form."""
    if isinstance(value, str):
        # A dollar sign could start a variable, which Spark replaces in SQL texts.
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"
    if isinstance(value, int):
        return str(value) if abs(value) < 2**63 else f"{value}BD" if abs(value) < 10**38 else None
    return f"{value!r}D" if math.isfinite(value) else None


def _members(cell: _Cell, values) -> list:
    """Operands of a membership test: only those of the cell's own type can match.

    Spark keeps a list of constants as a hash set, whatever its length; ids by the million are
    better given as a DataFrame.
    """
    if _is_text(cell.type):
        return [v for v in values if isinstance(v, str) and v != ""]
    if isinstance(cell.type, T.BooleanType):
        return [v for v in values if isinstance(v, bool)]
    if _is_date(cell.type):
        return list(values)
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if cell.is_id:
        numbers += [int(v) for v in values if isinstance(v, str) and re.fullmatch(r"-?\d+", v)]
    return numbers
