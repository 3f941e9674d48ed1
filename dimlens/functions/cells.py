"""Cell parsing: text to number or boolean, never raising under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a boolean and a plain identifier in a table cell.
NUMBER_CELL = r"(?i)^\s*-?(\d*\.?\d+|\d+\.?\d*)(e[-+]?\d+)?\s*$"
TRUE_CELLS = ("true", "TRUE")
FALSE_CELLS = ("false", "FALSE")
IDENTIFIER = r"^[a-z0-9_]*$"

# A number an operand comparison accepts: like a cell, with an optional plus sign.
LOOSE_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
NUMBER_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def parse_number(cell: Column) -> Column:
    """Number in a text cell, null for anything else."""
    return F.when(cell.rlike(NUMBER_CELL), cell.try_cast("double"))


def parse_boolean(cell: Column) -> Column:
    return F.when(cell.isin(*TRUE_CELLS), True).when(cell.isin(*FALSE_CELLS), False)


def parse_number_prefix(cell: Column) -> Column:
    """Longest leading number: ``12 km`` gives 12, ``1,234`` gives 1."""
    return F.nullif(F.regexp_extract(cell, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")


def loose_number(cell: Column) -> Column:
    """Number a text cell stands for when compared with a number."""
    return F.when(cell.rlike(LOOSE_NUMBER), cell.try_cast("double"))


def empty_to_null(cell: Column) -> Column:
    return F.nullif(cell, F.lit(""))


def is_identifier(cell: Column) -> Column:
    return cell.rlike(IDENTIFIER)
