"""Which keys and values exist: the declared index as rows, and the index found in the data."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.functions.concepts import ENTITY_TYPES
from dimlens.functions.keys import membership_column
from dimlens.model import COLLECTIONS, CONCEPTS, Dataset, Resource
from dimlens.operators.merge import ROW, filled, merge
from dimlens.session import small_table

_NAMES = T.ArrayType(T.StringType())
INDEX_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("key", _NAMES),
    T.StructField("value", T.StringType()), T.StructField("resources", _NAMES),
])


def index_rows(dataset: Dataset) -> DataFrame:
    """The index of a dataset as a table, the parts of each key sorted."""
    if dataset.index_table is not None:
        return dataset.index_table.select("kind", F.array_sort("key").alias("key"), "value", "resources")
    rows = [(e.kind, sorted(e.key), e.value, list(e.resources)) for e in dataset.index]
    return small_table(dataset.spark, INDEX_SCHEMA, rows)


def schema_view(dataset: Dataset, kind: str = "*") -> DataFrame:
    """``(key, value)`` pairs of one collection, or of all three one after the other."""
    rows = index_rows(dataset).filter(F.col("value") != "")
    kinds = COLLECTIONS if kind == "*" else (kind,)
    views = [rows.filter(F.col("kind") == k).select("key", "value") for k in kinds]
    return functools.reduce(DataFrame.unionByName, views)


def build_availability(dataset: Dataset) -> DataFrame:
    """``(kind, key, value, resources)`` found in the data, one row per key and value.

    A value exists under a key when some row holds it. A row keyed by an entity counts for the
    entity's domain and for every set the entity belongs to. Each resource is read once and
    shrinks to one row per entity before memberships are joined.
    """
    places = {name: place for place, name in enumerate(dataset.resources)}
    found, members = [], Memberships(dataset)
    for resource in dataset.resources.values():
        pairs = _resource_pairs(dataset, resource, members)
        if pairs is not None:
            holder = F.struct(F.lit(places[resource.name]).alias("place"),
                              F.lit(resource.name).alias("name"))
            found.append(pairs.withColumn("holder", holder))
    pairs = functools.reduce(DataFrame.unionByName, found)
    grouped = pairs.groupBy("kind", "key", "value").agg(
        F.transform(F.array_sort(F.collect_set("holder")), lambda h: h["name"]).alias("resources")
    )
    return grouped.select("kind", "key", "value", "resources")


def _resource_pairs(dataset: Dataset, resource: Resource, members) -> DataFrame | None:
    rows = dataset.frame(resource)
    values = resource.values
    if not values:
        return None
    held = {
        f"__v{i}": filled(F.col(f"`{v}`"), rows.schema[v].dataType) for i, v in enumerate(values)
    }
    if resource.kind == CONCEPTS:
        keyed = rows.agg(*[F.bool_or(c).alias(n) for n, c in held.items()])
        keyed = keyed.withColumn("key", F.array(F.lit("concept")))
    elif len(open_parts(dataset, resource.key)) == 1:
        return _pairs_by_bits(members, rows.withColumns(held), resource, values)
    else:
        combine = {n: F.bool_or for n in held}
        keyed = by_key_names(members, rows.withColumns(held), resource.key, combine)
    pairs = F.array(*[
        F.when(F.col(f"__v{i}"), F.lit(v)) for i, v in enumerate(values)
    ])
    return keyed.select(
        F.lit(resource.kind).alias("kind"), "key", F.explode(F.array_compact(pairs)).alias("value")
    )


def _pairs_by_bits(members: Memberships, rows: DataFrame, resource: Resource, values) -> DataFrame:
    """``(kind, key, value)`` pairs where one key part has sets: an id is one row, a set one bit.

    Ids are combined first, then joined with one row of bits each, and the bits of all ids that
    hold a value are united by an aggregation; names come back at the end, once.
    """
    dataset = members.dataset
    (part,) = open_parts(dataset, resource.key)
    domain = dataset.domain_of(part)
    names, ids = members.bits(domain)
    held = [f"__v{i}" for i in range(len(values))]
    rows = _combine(rows, [f"`{part}`"], {h: F.bool_or for h in held})
    left, right = F.col(f"`{part}`"), F.col("__id")
    if rows.schema[part].dataType != ids.schema["__id"].dataType:
        left, right = left.cast("string"), right.cast("string")
    words = [c for c in ids.columns if c != "__id"]
    united = rows.join(ids, left == right, "left").agg(
        *[F.bool_or(h).alias(h) for h in held],
        *[F.bit_or(F.when(F.col(h), F.col(w))).alias(f"{h}{w}") for h in held for w in words])
    others = [F.array(*map(F.lit, _names_without_members(dataset, p))) for p in resource.key if p != part]
    own = _names_without_members(dataset, part)
    entries = []
    for h, value in zip(held, values, strict=True):
        found = F.array_compact(F.array(*[
            F.when(F.coalesce(F.getbit(F.col(f"{h}{words[i // BITS]}"), F.lit(i % BITS)) == 1, F.lit(False)), F.lit(name))
            for i, name in enumerate(names)]))
        known = F.array_union(F.array(*map(F.lit, own)), found)
        entries.append(F.when(F.col(h), F.struct(F.lit(value).alias("value"), known.alias("names"))))
    rows = united.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select(
        "e.value", F.transform(F.col("e.names"), lambda n: F.array(n)).alias("keys"))
    for other in others:
        rows = rows.select("value", F.flatten(F.transform(other, _added_to(F.col("keys")))).alias("keys"))
    keyed = rows.select("value", F.explode("keys").alias("key"))
    return keyed.filter(F.size(F.array_distinct("key")) == len(resource.key)).select(
        F.lit(resource.kind).alias("kind"), F.array_sort("key").alias("key"), "value")


def _added_to(keys: Column):
    """A name added to each of the keys."""
    return lambda name: F.transform(keys, lambda key: F.array_append(key, name))


#: Sets in one word of bits.
BITS = 64


class Memberships:
    """Set memberships of a dataset's domains, each built once."""

    def __init__(self, dataset: Dataset):
        self.dataset = dataset
        self._built: dict[str, DataFrame] = {}

    def of(self, domain: str) -> DataFrame:
        if domain not in self._built:
            self._built[domain] = membership(self.dataset, domain).toDF("__id", "__sets")
        return self._built[domain]

    def bits(self, domain: str) -> tuple[list[str], DataFrame]:
        """The sets of a domain, and one row per entity with a bit for each set it belongs to."""
        names, entities = _sets(self.dataset, domain), _flagged(self.dataset, domain)
        if entities is None:
            return [], self.of(domain).select("__id")
        known = set(entities.columns)
        names = [n for n in names if membership_column(n) in known]
        words = []
        for start in range(0, len(names), BITS):
            bits = [F.shiftleft(F.col(f"`{membership_column(n)}`").cast("bigint"), i)
                    for i, n in enumerate(names[start:start + BITS])]
            bits = [F.coalesce(bit, F.lit(0).cast("bigint")) for bit in bits]
            words.append(functools.reduce(Column.bitwiseOR, bits).alias(f"__bits{start // BITS}"))
        return names, entities.select(F.col(f"`{domain}`").alias("__id"), *words)


def by_key_names(
    members: Memberships, rows: DataFrame, key: Sequence[str], combine: Mapping[str, object]
) -> DataFrame:
    """Rows per combination of key names: ``key array<string>`` and aggregates to combine on.

    Every key part stands for its own name, its domain and the sets its ids belong to. Rows are
    aggregated per combination of ids first; parts without sets need no ids and drop out there.
    The others are replaced by names one at a time, aggregating in between, so that every join
    meets rows that are combined already. A key may come more than once: the caller aggregates.
    """
    dataset = members.dataset
    opened = open_parts(dataset, key)
    no_names = F.array().cast(_NAMES)
    rows = _combine(rows, opened, combine)
    for place, part in enumerate(opened):
        sets = members.of(dataset.domain_of(part))
        names = F.array(*map(F.lit, _names_without_members(dataset, part)))
        left, right = F.col(f"`{part}`"), F.col("__id")
        if rows.schema[part].dataType != sets.schema["__id"].dataType:
            left, right = left.cast("string"), right.cast("string")
        rows = rows.join(sets, left == right, "left").select(
            *[F.col(f"`{c}`") for c in rows.columns if c != part],
            F.explode(F.array_union(names, F.coalesce("__sets", no_names))).alias(part),
        )
        if place < len(opened) - 1:
            rows = _combine(rows, opened, combine)
    for part in key:
        if part not in opened:
            names = [F.lit(name) for name in _names_without_members(dataset, part)]
            rows = rows.withColumn(part, F.explode(F.array(*names)) if names[1:] else names[0])
    named = F.array_sort(F.array(*[F.col(f"`{p}`") for p in key]))
    return rows.filter(F.size(F.array_distinct(named)) == len(key)).select(
        named.alias("key"), *combine
    )


def membership(dataset: Dataset, domain: str) -> DataFrame:
    """``(id, sets)`` of a domain: the sets each entity belongs to, all entity files merged."""
    entities = _flagged(dataset, domain)
    if entities is None:
        schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("sets", _NAMES)])
        return small_table(dataset.spark, schema, [])
    found = F.array_compact(F.array(*[
        F.when(F.col(f"`{membership_column(name)}`"), F.lit(name))
        for name in _sets(dataset, domain)
        if membership_column(name) in entities.columns
    ]))
    return entities.select(F.col(f"`{domain}`").alias("id"), found.alias("sets"))


def _flagged(dataset: Dataset, domain: str) -> DataFrame | None:
    """The domain's entities with their membership columns, None if no resource has one."""
    flags = {membership_column(s) for s in _sets(dataset, domain)}
    frames, orders = [], []
    for resource in dataset.resources.values():
        if len(resource.key) == 1 and dataset.domain_of(resource.key[0]) == domain:
            held = [c for c in resource.values if c in flags]
            if held:
                rows = resource.ordered(resource.frame)
                held += [ROW] if resource.row_order is not None else []
                rows = rows.select(resource.key[0], *[F.col(f"`{c}`") for c in held])
                frames.append(dataset.frame(resource, rows).withColumnRenamed(resource.key[0], domain))
                orders.append(F.col(ROW) if resource.row_order is not None else None)
    return merge(frames, [domain], row_orders=orders) if frames else None


def _combine(rows: DataFrame, parts: Sequence[str], combine: Mapping[str, object]) -> DataFrame:
    aggregates: list[Column] = [f(F.col(name)).alias(name) for name, f in combine.items()]
    return rows.groupBy(*parts).agg(*aggregates)


def open_parts(dataset: Dataset, key: Sequence[str]) -> list[str]:
    """Key parts whose ids belong to sets."""
    return [part for part in key if _sets(dataset, part)]


def _sets(dataset: Dataset, part: str) -> list[str]:
    if dataset.type_of(part) not in ENTITY_TYPES:
        return []
    return dataset.sets_of(dataset.domain_of(part))


def _names_without_members(dataset: Dataset, part: str) -> list[str]:
    if dataset.type_of(part) not in ENTITY_TYPES:
        return [part]
    return list(dict.fromkeys([part, dataset.domain_of(part)]))
