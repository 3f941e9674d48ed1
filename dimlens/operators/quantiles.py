"""Quantiles of values from sketches that are stored beside a resource and merged when asked for."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.model import Dataset, Resource
from dimlens.operators.availability import Memberships, by_key_names, open_parts


def numeric_values(dataset: Dataset, resource: Resource) -> list[str]:
    """Values of a resource that are numbers."""
    schema = dataset.frame(resource).schema
    return [v for v in resource.values if isinstance(schema[v].dataType, T.NumericType)]


def value_sketches(dataset: Dataset, resource: Resource, rows: DataFrame | None = None) -> DataFrame:
    """One row per combination of ids that belong to sets: a KLL sketch of each numeric value.

    ``rows`` are new rows of the resource, such as a file that came: its sketches stand beside those
    of earlier ones, so that it costs no more than itself. Store the result as a table.
    """
    rows = dataset.frame(resource, rows)
    sketches = [
        F.kll_sketch_agg_double(F.col(f"`{v}`").cast("double")).alias(f"sketch{i}")
        for i, v in enumerate(numeric_values(dataset, resource))]
    return rows.groupBy(*[f"`{p}`" for p in open_parts(dataset, resource.key)]).agg(*sketches)


def quantiles(
    dataset: Dataset, resource: Resource, sketches: Sequence[DataFrame], fractions: Sequence[float]
) -> DataFrame:
    """``(key, value, n, quantiles)`` under every key that the resource's key stands for.

    The sketches of all files are merged, those of ids by the sets they belong to now; the rows they
    came from are not read. ``quantiles`` holds one number per fraction, whose rank is off by about
    1.65 hundredths of ``n`` at most with the usual size of sketches; 0 and 1 give the exact extremes.
    """
    values = numeric_values(dataset, resource)
    rows = functools.reduce(DataFrame.unionByName, sketches)
    combine = {f"sketch{i}": F.kll_merge_agg_double for i in range(len(values))}
    keyed = by_key_names(Memberships(dataset), rows, resource.key, combine)
    keyed = keyed.groupBy("key").agg(*[f(F.col(n)).alias(n) for n, f in combine.items()])
    entries = F.array(*[
        F.struct(F.lit(v).alias("value"), F.col(f"sketch{i}").alias("sketch")) for i, v in enumerate(values)])
    found = keyed.select("key", F.explode(entries).alias("e")).select(
        "key", "e.*", F.kll_sketch_get_n_double("e.sketch").alias("n")).filter(F.col("n") > 0)
    return found.select("key", "value", "n", F.array(*[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))) for f in fractions]).alias("quantiles"))
