"""The query: key, values, condition, joins, language and order in, one lazy DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.functions.cells import empty_to_null
from dimlens.functions.keys import membership_column
from dimlens.model import CONCEPTS, ENTITIES, Dataset, Resource
from dimlens.operators.availability import schema_view
from dimlens.operators.merge import RESOURCE, ROW, TRANSLATION, merge
from dimlens.operators.normalize import apply_parsers
from dimlens.operators.order import order_rows
from dimlens.operators.predicates import (
    IdJoin,
    InlinedJoin,
    column_bounds,
    compile_condition,
    join_references,
    plain_conjuncts,
    referenced_fields,
    required_id_joins,
    required_id_keys,
    semi_join,
)
from dimlens.operators.rename import key_renames
from dimlens.plans import checks
from dimlens.plans.statistics import value_statistics


def query(
    dataset: Dataset,
    collection: str,
    key: Sequence[str],
    value: Sequence[str] = (),
    where: Mapping[str, Any] | None = None,
    join: Mapping[str, Mapping[str, Any]] | None = None,
    order_by=None,
    language: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Rows of a collection (``concepts``, ``entities``, ``datapoints`` or a ``….schema``).

    Merging comes before filtering: a condition on a value sees the value that won the merge.
    With ``strict=False`` an unknown value gives an empty column instead of an error.
    """
    key, value = list(key), list(value or ())
    checks.check_structure(collection, key, value, where, join, order_by, language)
    if collection in checks.SCHEMAS:
        checks.check_schema_names(value)
        rows = _schema_rows(dataset, collection.split(".")[0], value)
        rows = compile_condition(where, rows).apply(rows)
        return order_rows(rows.select(*dict.fromkeys(["key", "value", *value])), order_by)
    if strict:
        checks.check_names(dataset, collection, key, value)
    joins = _joins(dataset, where, join)
    # The ids of a join on a set are members of it already.
    limited = required_id_keys(where, joins)
    sets = [k for k in key if dataset.type_of(k) == "entity_set" and k not in limited]
    # Ids limit the key, which a merge keeps, so every resource meets them before its rows are
    # shuffled; and the rest of the condition no longer needs those joins.
    ids = [IdJoin(name, members(dataset, name)) for name in sets]
    ids += required_id_joins(where, joins, key)
    rows = _merged(dataset, key, value, where, joins, language, ids)
    condition = compile_condition(where, rows, joins, key)
    condition.semi_joins = [j for j in condition.semi_joins if not any(j.ids is i.ids for i in ids)]
    rows = condition.apply(rows)
    selected = list(dict.fromkeys(key + value))
    rows = rows.select(*[_column(dataset, rows, name) for name in selected])
    return order_rows(rows, order_by, ties=key)


def read(
    dataset: Dataset,
    request: Mapping[str, Any],
    parsers: Mapping[str, Callable[[Column], Column]] | None = None,
    transformer: Callable[[DataFrame], DataFrame] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Answer a query given as one mapping; members that mean nothing to it are ignored."""
    select = request.get("select") or {}
    rows = query(
        dataset,
        request.get("from"),
        select.get("key") or (),
        select.get("value") or (),
        where=request.get("where"),
        join=request.get("join"),
        order_by=request.get("order_by"),
        language=request.get("language"),
        strict=strict,
    )
    rows = apply_parsers(rows, parsers or {})
    return rows.transform(transformer) if transformer else rows


def members(dataset: Dataset, set_name: str) -> DataFrame:
    """Ids of an entity set: members of its domain whose flag is true."""
    domain, flag = dataset.domain_of(set_name), membership_column(set_name)
    rows = query(dataset, ENTITIES, [domain], [flag], where={flag: True}, strict=False)
    return rows.select(domain)


def _joins(dataset, where, join) -> dict[str, IdJoin | InlinedJoin]:
    """Targets of the joins that the condition mentions."""
    targets = {}
    for name in join_references(where):
        key, condition = join[name]["key"], join[name].get("where") or {}
        if dataset.type_of(key) == "time":
            targets[name] = InlinedJoin(condition)
        else:
            collection = CONCEPTS if key == "concept" else ENTITIES
            ids = query(dataset, collection, [key], where=condition, strict=False)
            targets[name] = IdJoin(key, ids)
    return targets


def _merged(dataset, key, value, where, joins, language, ids) -> DataFrame:
    """All resources of the key and values as one table, before any filter on values."""
    hidden = [f for f in referenced_fields(where) if f not in key and f not in value]
    resources = dataset.resolve(key, value + hidden)
    if not resources:
        schema = T.StructType([T.StructField(k, T.StringType()) for k in key])
        return dataset.spark.createDataFrame([], schema)
    wanted, bounds = {*value, *hidden}, column_bounds(where, joins)
    part = plain_conjuncts(where, joins, key)["$and"]
    frames, places = [], []
    for group, own in _scans(resources):
        together = {r.path: p for r, p in zip(group, own, strict=True)} if len(own) > 1 else {}
        rows = _prepared(dataset, group[0], key, wanted, language, bounds, ids, part, together)
        frames.append(rows)
        places.append(own)
    return merge(frames, key, row_orders=[_order(rows) for rows in frames], places=places)


def _scans(resources: Sequence[Resource]):
    """Resources that one scan reads, with their places."""
    groups: dict[Any, tuple[list[Resource], list[int]]] = {}
    for place, resource in enumerate(resources):
        group, own = groups.setdefault(place if resource.scan is None else resource.scan, ([], []))
        group.append(resource)
        own.append(place)
    return groups.values()


def _order(rows: DataFrame) -> Column | None:
    return F.col(ROW) if ROW in rows.columns else None


def _prepared(
    dataset, resource: Resource, key, wanted, language, bounds, ids, part, together
) -> DataFrame:
    """One resource: limited by its key, translated, pruned, keyed by the query's names.

    Or all resources of its scan whose places ``together`` gives by their paths.
    """
    renames = key_renames(dataset, key, resource.key)
    names = {renames.get(name, name): name for name in resource.key}
    taken_over = {names[j.key]: j.ids for j in ids if names.get(j.key) in resource.limited_by}
    if together:
        rows = resource.scan.open(together)
    else:
        rows = resource.rows({names[k]: b for k, b in bounds.items() if k in names}, taken_over)
    # Before rows are numbered, which a filter does not pass, so that it reaches the scan.
    own = {"$and": [{names[k]: test} for p in part for k, test in p.items() if k in names]}
    rows = resource.ordered(compile_condition(own, rows, {}, resource.key).apply(rows))
    if language:
        rows = _translated(resource, rows, language, own, together)
    taken = set(renames.values()) - set(resource.key)
    kept = [c for c in rows.columns
            if c in (ROW, RESOURCE) or c in resource.key or c in wanted and c not in taken]
    rows = dataset.frame(resource, rows.select(*[F.col(f"`{c}`") for c in kept]))
    rows = rows.withColumnsRenamed(renames) if renames else rows
    for join in ids:
        if names.get(join.key) not in taken_over:
            rows = semi_join(rows, join)
    return rows


def _translated(resource: Resource, rows: DataFrame, language: str, own, together) -> DataFrame:
    """Rows with the filled cells of their translation, and with the rows that only that has.

    ``own`` is the condition on the key, which limits the translation too.
    """
    if together:
        found = resource.scan.translated(language, together)
    else:
        table = resource.translation(language)
        found = [] if table is None else [table]
    if not found:
        return rows
    found = [compile_condition(own, t, {}, resource.key).apply(t) for t in found]
    marked = {RESOURCE: "__table"} if together else {}
    frames = [rows, *[t.select(*[c for c in t.columns if c in rows.columns]) for t in found]]
    merged = merge(
        [f.withColumnsRenamed(marked) for f in frames], [*marked.values(), *resource.key], TRANSLATION,
        [_order(rows), *[None] * len(found)],
    )
    return merged.withColumnsRenamed({v: k for k, v in marked.items()})


def _column(dataset, rows, name) -> Column:
    if name in rows.columns:
        cell = F.col(f"`{name}`")
        text = isinstance(rows.schema[name].dataType, T.StringType)
        return empty_to_null(cell).alias(name) if text else cell
    return F.lit(None).cast(dataset.data_type(name)).alias(name)


def _schema_rows(dataset, kind, value) -> DataFrame:
    pairs = schema_view(dataset, kind)
    if not value:
        return pairs
    statistics = value_statistics(dataset, kind, value)
    return (
        pairs.alias("p")
        .join(
            statistics.alias("s"),
            (F.col("p.key") == F.col("s.key")) & (F.col("p.value") == F.col("s.value")),
            "left",
        )
        .select("p.key", "p.value", *[F.col(f"s.`{v}`") for v in value])
    )
