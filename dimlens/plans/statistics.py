"""Minimum, maximum and mean of every indicator under every key it is available for."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.model import COLLECTIONS, CONCEPTS, Dataset
from dimlens.operators.availability import Memberships, by_key_names
from dimlens.operators.merge import ROW, merge
from dimlens.operators.rename import key_renames


def value_statistics(
    dataset: Dataset, kind: str = "*", statistics: Sequence[str] = ("min(value)",)
) -> DataFrame:
    """``(key, value, …)`` with the statistics asked for; no row for a text indicator.

    The resources of a key merge at the level of entity domains, so that an overwritten value
    does not count, and one pass serves the domains and all of their sets.
    """
    kinds = COLLECTIONS if kind == "*" else (kind,)
    groups: dict[tuple, list] = {}
    for resource in dataset.resources.values():
        if resource.kind in kinds and resource.kind != CONCEPTS:
            domains = tuple(sorted(dataset.domain_of(part) for part in resource.key))
            groups.setdefault(domains, []).append(resource)
    members = Memberships(dataset)
    parts = [_group_statistics(members, key, found) for key, found in groups.items()]
    parts = [p for p in parts if p is not None]
    if not parts:
        columns = ", ".join(f"`{s}` double" for s in statistics)
        return dataset.spark.createDataFrame([], f"key array<string>, value string, {columns}")
    rows = functools.reduce(DataFrame.unionByName, parts)
    cells = {
        "min(value)": F.col("low"),
        "max(value)": F.col("high"),
        "avg(value)": F.col("total") / F.col("filled"),
    }
    return rows.select("key", "value", *[cells[s].alias(s) for s in statistics])


def _group_statistics(members: Memberships, key, resources) -> DataFrame | None:
    dataset = members.dataset
    frames, orders = [], []
    for resource in resources:
        rows = resource.ordered(dataset.frame(resource))
        order = [ROW] if resource.row_order is not None else []
        numbers = [
            f.name
            for f in rows.schema
            if f.name not in resource.key and isinstance(f.dataType, T.NumericType)
        ]
        if numbers:
            numbers = [F.col(f"`{n}`").cast("double").alias(n) for n in numbers]
            rows = rows.select(*resource.key, *numbers, *order)
            renames = key_renames(dataset, key, resource.key)
            frames.append(rows.withColumnsRenamed(renames) if renames else rows)
            orders.append(F.col(ROW) if order else None)
    if not frames:
        return None
    rows = merge(frames, key, row_orders=orders)
    measures = [c for c in rows.columns if c not in key]
    cells, combine = {}, {}
    for place, name in enumerate(measures):
        cell = F.col(f"`{name}`")
        cells |= {f"__low{place}": cell, f"__high{place}": cell, f"__total{place}": cell,
                  f"__filled{place}": cell.isNotNull().cast("bigint")}
        combine |= {f"__low{place}": F.min, f"__high{place}": F.max, f"__total{place}": F.sum,
                    f"__filled{place}": F.sum}
    keyed = by_key_names(members, rows.select(*key, *[c.alias(n) for n, c in cells.items()]),
                         key, combine)
    keyed = keyed.groupBy("key").agg(*[f(F.col(n)).alias(n) for n, f in combine.items()])
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("value"),
            F.col(f"__low{place}").alias("low"),
            F.col(f"__high{place}").alias("high"),
            F.col(f"__total{place}").alias("total"),
            F.col(f"__filled{place}").alias("filled"),
        )
        for place, name in enumerate(measures)
    ])
    return (
        keyed.select("key", F.explode(entries).alias("entry"))
        .select("key", "entry.*")
        .filter(F.col("filled") > 0)
    )
