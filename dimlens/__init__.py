"""Queries over dimensional datasets: concepts, entities and datapoints as Spark DataFrames."""

from dimlens.errors import DatasetError, QueryError
from dimlens.model import Concept, Dataset, IndexEntry, Resource
from dimlens.plans.query import query, read
from dimlens.plans.reader import Reader
from dimlens.sources.catalog import Version
from dimlens.sources.manifest import open_folder, open_version

__all__ = [
    "Concept",
    "Dataset",
    "DatasetError",
    "IndexEntry",
    "QueryError",
    "Reader",
    "Resource",
    "Version",
    "open_folder",
    "open_version",
    "query",
    "read",
]
