"""Assets: files below the asset folder of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dimlens.errors import DatasetError

# Fixed value: the folder that holds the assets of a dataset.
ASSET_FOLDER = "assets"


def asset_path(folder: str, path: str) -> str:
    """Full path of an asset; raises for a path that leaves the asset folder."""
    parts = path.strip("/").split("/")
    if parts[0] != ASSET_FOLDER or len(parts) < 2 or any(p in ("", ".", "..") for p in parts):
        raise DatasetError(f"{path!r} is not below {ASSET_FOLDER}/")
    return "/".join([folder.rstrip("/"), *parts])


def get_asset(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """JSON files as rows, any other file as one row of ``value`` text."""
    full = asset_path(folder, path)
    if path.endswith(".json"):
        return spark.read.json(full, multiLine=True)
    return spark.read.text(full, wholetext=True)


def get_binary_asset(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """``(path, modificationTime, length, content)`` of asset files."""
    return spark.read.format("binaryFile").load(asset_path(folder, path))
