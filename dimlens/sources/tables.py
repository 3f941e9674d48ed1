"""Delimited text resources."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import quote, unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.errors import DatasetError

# The delimiters that a header line can show.
DELIMITERS = ",\t|;\x1e\x1f"


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str | None = None,
    multiline: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of delimited files with a header, all cells text, blank lines skipped.

    ``columns`` are the names in the header, which each file is checked for; with them and the
    ``delimiter`` nothing is read before the rows are. Without them the header line of the first
    path tells. ``multiline`` allows line breaks inside quotes, for which a file has to stay in one
    task; files without any are read in splits when it is off.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if delimiter is None or columns is None:
        line = header_line(spark, paths[0])
        delimiter = delimiter or header_delimiter(line, paths[0])
        columns = columns or next(csv.reader([line], delimiter=delimiter))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return spark.read.schema(schema).csv(
        paths, header=True, enforceSchema=False, sep=delimiter, quote='"', escape='"',
        multiLine=multiline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def row_number_in_file() -> Column:
    """Row order inside one table: by file, then along it, without a shuffle."""
    return F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a file; one task reads it."""
    lines = spark.read.text(path).filter(F.col("value") != "").head(1)
    if not lines:
        raise DatasetError(f"{path} has no header")
    return lines[0].value.removeprefix("\ufeff")


def header_lines(spark: SparkSession, folder: str) -> dict[str, str]:
    """The first line of every file below a folder, by its path there; found by one job, none if there is no folder."""
    try:
        lines = spark.read.option("recursiveFileLookup", True).text(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    base = quote(urlparse(folder).path) + "/"
    first = lines.filter((F.col("value") != "") & (F.col("_metadata.file_block_start") == 0)).select(
        F.substring_index(F.col("_metadata.file_path"), base, -1).alias("file"),
        "value", F.monotonically_increasing_id().alias("row"),
    ).groupBy("file").agg(F.min_by("value", "row").alias("line"))
    return {unquote(r["file"]): r["line"].removeprefix("\ufeff") for r in first.collect()}


def header_delimiter(line: str, path: str = "the table") -> str:
    """The delimiter that a header shows outside quotes; a comma if it has one column only."""
    outside = "".join(line.split('"')[::2])
    shown = [d for d in DELIMITERS if d in outside]
    if len(shown) > 1:
        raise DatasetError(f"the header of {path} shows several delimiters; name one in its dialect")
    return shown[0] if shown else ","


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
