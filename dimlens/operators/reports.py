"""Reports on a dataset: rejected cells, undefined columns, sizes."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.functions.cells import parse_boolean, parse_number
from dimlens.model import COLLECTIONS, CONCEPTS, Dataset, Resource
from dimlens.operators import merge as merging
from dimlens.operators.rename import key_renames


def rejected_cells(dataset: Dataset, resource: Resource) -> DataFrame:
    """``(key…, column, cell)``: filled text cells that are not of their concept's type."""
    rows = resource.frame
    parsers = {"measure": parse_number, "boolean": parse_boolean}
    cells = []
    for column in rows.schema:
        parser = parsers.get(dataset.type_of(column.name))
        if parser and isinstance(column.dataType, T.StringType) and column.name not in resource.key:
            cell = F.col(f"`{column.name}`")
            bad = (cell != "") & parser(cell).isNull()
            cells.append(F.when(bad, F.struct(F.lit(column.name).alias("column"),
                                              cell.alias("cell"))))
    key = [F.col(f"`{k}`") for k in resource.key]
    if not cells:
        return rows.select(*key, F.lit("").alias("column"), F.lit("").alias("cell")).limit(0)
    return (
        rows.select(*key, F.explode(F.array_compact(F.array(*cells))).alias("bad"))
        .select(*key, "bad.*")
    )


def unknown_names(requested: DataFrame, name: str, concepts: DataFrame) -> DataFrame:
    """Names asked for that no concept defines, with how often: ``(name, rows)``."""
    counted = requested.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("rows"))
    defined = concepts.select(F.col("concept").alias("name"))
    return counted.join(defined, "name", "left_anti")


def unknown_columns(dataset: Dataset) -> DataFrame:
    """``(resource, column)`` of the resource columns that no concept defines."""
    pairs = [
        (resource.name, column)
        for resource in dataset.resources.values()
        if resource.kind != CONCEPTS
        for column in resource.frame.columns
        if column not in dataset.dictionary
    ]
    return dataset.spark.createDataFrame(pairs, "resource string, column string")


def repeated_keys(dataset: Dataset) -> DataFrame:
    """``(resource, key, rows)`` of the keys that a resource declared unique has more than once.

    ``key`` holds the parts as text; a key with a missing part is reported too, with any number of
    rows, as a unique key is complete. Rows are counted before the shuffle.
    """
    reports = []
    for resource in dataset.resources.values():
        if resource.unique:
            parts = [F.col(f"`{k}`").cast("string").alias(k) for k in resource.key]
            counted = resource.frame.groupBy(*[f"`{k}`" for k in resource.key]).agg(F.count("*").alias("__rows"))
            missing = functools.reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in resource.key])
            reports.append(counted.filter((F.col("__rows") > 1) | missing).select(
                F.lit(resource.name).alias("resource"), F.array(*parts).alias("key"),
                F.col("__rows").alias("rows")))
    if not reports:
        return dataset.spark.createDataFrame([], "resource string, key array<string>, rows bigint")
    return functools.reduce(DataFrame.unionByName, reports)


def merge_conflicts(dataset: Dataset, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``(key…, columns)`` where two resources hold different values for a key."""
    frames = []
    for resource in dataset.resolve(key, values):
        rows = dataset.frame(resource)
        kept = [c for c in rows.columns if c in resource.key or c in values]
        renames = key_renames(dataset, key, resource.key)
        frames.append(rows.select(*kept).withColumnsRenamed(renames))
    return merging.conflicts(frames, key)


def dataset_sizes(dataset: Dataset, languages: Sequence[str] = ()) -> DataFrame:
    """Rows per collection, and translated rows, of a dataset: one row."""
    kinds = [*COLLECTIONS, "translations"]
    counts = []
    for resource in dataset.resources.values():
        counts.append(_count(resource.frame, resource.kind))
        for language in languages:
            translation = resource.translation(language)
            if translation is not None:
                counts.append(_count(translation, "translations"))
    rows = functools.reduce(DataFrame.unionByName, counts)
    sizes = rows.withColumn("dataset", F.lit(dataset.name)).groupBy("dataset")
    return sizes.pivot("kind", kinds).sum("rows").fillna(0, kinds)


def _count(rows: DataFrame, kind: str) -> DataFrame:
    return rows.agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))
