"""Result files and the folder form of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.model import Dataset, IndexEntry
from dimlens.sources.manifest import MANIFEST, TRANSLATION_FOLDER, manifest_text


def tabular(rows: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Columns of a result in request order, none twice, a missing one null."""
    return rows.select(*[
        F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c)
        for c in dict.fromkeys([*key, *value])
    ])


def json_lines(rows: DataFrame) -> DataFrame:
    """``value``: each row as the line that :func:`write_json` writes for it."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """``value``: each row as the line that :func:`write_csv` writes for it."""
    return rows.select(F.to_csv(F.struct("*"), {"escape": '"'}).alias("value"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; nulls are written, so that every row has every column."""
    rows.write.json(path, mode=mode, ignoreNullFields=False)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.csv(path, mode=mode, header=True, escape='"')


def write_parquet(
    rows: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Columnar result; partitioned by a selective dimension, later filters on it skip files."""
    rows.write.parquet(path, mode=mode, partitionBy=list(partition_by) or None)


def write_folder(
    dataset: Dataset,
    folder: str,
    index: Sequence[IndexEntry] | None = None,
    languages: Sequence[str] = (),
) -> None:
    """Store a dataset as delimited files with a manifest, the form that a folder is read from."""
    resources = list(dataset.resources.values())
    paths = {r.name: f"{r.name}.csv" for r in resources}
    for resource in resources:
        write_csv(resource.frame, f"{folder}/{paths[resource.name]}")
        for language in languages:
            translation = resource.translation(language)
            if translation is not None:
                target = f"{folder}/{TRANSLATION_FOLDER}/{language}/{paths[resource.name]}"
                write_csv(translation, target)
    text = manifest_text(resources, index or dataset.index, paths, languages)
    manifest = dataset.spark.createDataFrame([(text,)], "value string")
    manifest.coalesce(1).write.text(f"{folder}/{MANIFEST}")


def write_clustered(
    rows: DataFrame, path: str, dimensions: Sequence[str], rows_per_file: int = 1_000_000, cells: int = 64
) -> None:
    """Parquet laid out along a space-filling curve, so that a filter on any one dimension skips files.

    Every dimension is cut into at most ``cells`` ranges of about as many rows each, whose bounds come
    from a bounded sample; the bits of a row's ranges are interleaved to its place on the curve, and
    rows are range-partitioned and sorted by it. Files then hold small boxes of the key space, which
    Parquet's minima and maxima describe. Bounds only decide where rows lie: no row is left out, and
    rows of one place are split over files. Empty cells count as the lowest range.
    """
    bounds = _range_bounds(rows, dimensions, cells)
    # Dimensions of few ranges are stretched, so that the first bits of all halve the rows.
    ranges = {
        f"__range{i}": F.floor(_range_of(F.col(f"`{d}`"), bounds[d]) * cells / (len(bounds[d]) + 1)).cast("int")
        for i, d in enumerate(dimensions)}
    place = F.lit(0).cast("bigint")
    for bit in range(max(1, (cells - 1).bit_length())):
        for i, number in enumerate(ranges):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("bigint")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(ranges) + i))
    files = max(1, -(-rows.count() // rows_per_file))
    # A second column splits places that many rows share.
    within = F.xxhash64(*[F.col(f"`{d}`") for d in dimensions])
    placed = rows.withColumns(ranges).withColumns({"__place": place, "__within": within})
    placed = placed.repartitionByRange(files, "__place", "__within").sortWithinPartitions(
        "__place", *[f"`{d}`" for d in dimensions])
    placed.drop("__place", "__within", *ranges).write.parquet(path)


#: Rows that the bounds of ranges are taken from.
SAMPLED = 100_000


def _range_bounds(rows: DataFrame, dimensions: Sequence[str], cells: int) -> dict[str, list]:
    """The least value of every range but the first, by dimension."""
    chosen = rows.select(*[f"`{d}`" for d in dimensions])
    sample = chosen.orderBy(F.xxhash64(*chosen.columns, F.monotonically_increasing_id())).limit(SAMPLED).toArrow()
    bounds = {}
    for d in dimensions:
        values = sorted(v for v in sample[d].to_pylist() if v is not None)
        cuts = [values[len(values) * i // cells] for i in range(1, cells)] if values else []
        bounds[d] = sorted(set(cuts))
    return bounds


def _range_of(cell: Column, bounds: Sequence) -> Column:
    """How many bounds a cell reaches, found by halving."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(cell >= F.lit(bounds[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return F.coalesce(search(0, len(bounds)), F.lit(0))
