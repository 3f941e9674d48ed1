"""Alignment of entity domains and sets: a column keyed by one answers for the other."""

from __future__ import annotations

from collections.abc import Sequence

from dimlens.functions.concepts import ENTITY_TYPES


def key_renames(dataset, key: Sequence[str], resource_key: Sequence[str]) -> dict[str, str]:
    """Renames that bring the key columns of a resource to the names a query asks for.

    A set takes the column of its domain or of a sibling set, a domain that of any of its sets.
    A column that the query names itself keeps its name.
    """
    renames: dict[str, str] = {}
    for wanted in key:
        if wanted in resource_key or dataset.type_of(wanted) not in ENTITY_TYPES:
            continue
        domain = dataset.domain_of(wanted)
        for part in resource_key:
            if part in key or part in renames or dataset.type_of(part) not in ENTITY_TYPES:
                continue
            if dataset.domain_of(part) == domain:
                renames[part] = wanted
                break
    return renames
