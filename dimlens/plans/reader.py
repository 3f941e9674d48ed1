"""Requests that name their dataset version, answered from a folder of versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from dimlens.model import Dataset
from dimlens.plans.query import read
from dimlens.sources.assets import get_asset
from dimlens.sources.catalog import Version
from dimlens.sources.manifest import open_version


class Reader:
    """Datasets below ``base``, each opened once.

    ``versions`` maps datasets to branches and commits, ``default`` fills the gaps of a request.
    Neither is needed where ``base`` itself is a dataset. ``transformer`` gets every result.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        versions: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
        default: Version | None = None,
        transformer: Callable[[DataFrame], DataFrame] | None = None,
        **options,
    ):
        self.spark = spark
        self.base = base
        self.versions = versions
        self.default = default
        self.transformer = transformer
        self.options = options
        self._opened: dict[tuple, Dataset] = {}

    def dataset(
        self, dataset: str | None = None, branch: str | None = None, commit: str | None = None
    ) -> Dataset:
        version = (dataset, branch, commit)
        if version not in self._opened:
            self._opened[version] = open_version(
                self.spark, self.base, self.versions, self.default, *version, **self.options
            )
        return self._opened[version]

    def read(
        self,
        request: Mapping[str, Any],
        parsers: Mapping[str, Callable[[Column], Column]] | None = None,
    ) -> DataFrame:
        """Answer a request; ``dataset``, ``branch`` and ``commit`` in it choose the version."""
        dataset = self.dataset(*(request.get(part) for part in ("dataset", "branch", "commit")))
        return read(dataset, request, parsers, self.transformer)

    def asset(self, path: str, **version: str) -> DataFrame:
        """An asset of a dataset version."""
        return get_asset(self.spark, self.dataset(**version).folder, path)
