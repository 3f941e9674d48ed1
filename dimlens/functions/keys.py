"""Names of keys, entity sets and their membership columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix of the boolean column that marks membership in an entity set.
MEMBERSHIP_PREFIX = "is--"


def key_text(key: Iterable[str]) -> str:
    """Canonical name of a key: its parts sorted and joined."""
    return ",".join(sorted(key))


def canonical_key(key: Column) -> Column:
    """Column form of :func:`key_text` over an array column."""
    return F.array_join(F.array_sort(key), ",")


def membership_column(set_name: str) -> str:
    return MEMBERSHIP_PREFIX + set_name


def set_name(column: Column) -> Column:
    """Set that a membership column stands for."""
    return F.regexp_replace(column, f"^{MEMBERSHIP_PREFIX}", "")


def sets_of_row(flags: Mapping[str, Column], fallback: Column | None = None) -> Column:
    """Array of the sets whose flag is true; ``[fallback]`` when no flag is."""
    sets = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    if fallback is None:
        return sets
    return F.when(F.size(sets) == 0, F.array(fallback)).otherwise(sets)
