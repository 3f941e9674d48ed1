"""Argument checks made before a query runs."""

from __future__ import annotations

from collections.abc import Mapping

from dimlens.errors import QueryError
from dimlens.model import COLLECTIONS, CONCEPTS, DATAPOINTS, ENTITIES
from dimlens.operators.order import order_terms
from dimlens.operators.predicates import join_references

# What a query may read from, and columns known without a concept.
SCHEMAS = ("concepts.schema", "entities.schema", "datapoints.schema", "*.schema")
CONCEPT_COLUMNS = ("concept", "concept_type", "domain", "unit", "drill_up")
STATISTICS = ("min(value)", "max(value)", "avg(value)")
KEY_TYPES = {
    DATAPOINTS: ("entity_set", "entity_domain", "time"),
    ENTITIES: ("entity_set", "entity_domain"),
}


def check_structure(collection, key, value, where, join, order_by, language) -> None:
    """Raise a :class:`QueryError` that lists everything wrong with the shape of a query."""
    problems = []
    if collection not in COLLECTIONS + SCHEMAS:
        raise QueryError(f"unknown collection {collection!r}")
    schema = collection in SCHEMAS
    if schema:
        if sorted(key) != ["key", "value"]:
            problems.append("a schema query has exactly the keys 'key' and 'value'")
        if language is not None:
            problems.append("a schema query takes no language")
    elif collection == DATAPOINTS:
        if len(key) < 2:
            problems.append("a datapoint query needs at least two keys")
        if len(set(key)) != len(key):
            problems.append("a datapoint query has repeated keys")
        if not value:
            problems.append("a datapoint query needs at least one value")
    elif len(key) != 1:
        problems.append(f"a query on {collection} has exactly one key")
    for name in (*key, *value):
        if not isinstance(name, str):
            problems.append(f"column names are text, not {name!r}")
    if where is not None and not isinstance(where, Mapping):
        problems.append("where is a mapping")
    if join and (schema or collection == CONCEPTS):
        problems.append(f"a query on {collection} takes no join")
    if join is not None and not isinstance(join, Mapping):
        problems.append("join is a mapping")
    else:
        for name, target in (join or {}).items():
            if not isinstance(target, Mapping) or not isinstance(target.get("key"), str):
                problems.append(f"join {name} needs a key")
        if isinstance(where, Mapping):
            unknown = sorted(join_references(where) - set(join or {}))
            problems += [f"unknown join {name}" for name in unknown]
    if language is not None and not isinstance(language, str):
        problems.append("language is text")
    try:
        order_terms(order_by)
    except QueryError as error:
        problems += error.problems
    if problems:
        raise QueryError(problems)


def check_names(dataset, collection, key, value) -> None:
    """Raise for keys and values that the concept table does not allow."""
    problems = []
    if collection == CONCEPTS:
        problems += [f"unknown key {k}" for k in key if k != "concept"]
        known = set(CONCEPT_COLUMNS)
    else:
        allowed = KEY_TYPES[collection]
        problems += [f"{k} cannot be a key here" for k in key if dataset.type_of(k) not in allowed]
        known = set()
    unknown = [v for v in value if v not in dataset.dictionary and v not in known]
    if unknown:
        defined = dataset.lookup(unknown)
        problems += [f"unknown value {v}" for v in unknown if v not in defined]
    if problems:
        raise QueryError(problems)


def check_schema_names(value) -> None:
    unknown = [v for v in value if v not in STATISTICS]
    if unknown:
        raise QueryError([f"unknown value {v}" for v in unknown])
