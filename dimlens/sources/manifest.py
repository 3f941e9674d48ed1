"""Datasets in folders: a manifest of resources, delimited files, translations."""

from __future__ import annotations

import csv
import functools
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.errors import DatasetError
from dimlens.model import COLLECTIONS, Dataset, IndexEntry, Resource
from dimlens.operators.merge import RESOURCE
from dimlens.session import small_table
from dimlens.sources.catalog import Version, flatten_catalog, registry_from, resolve_version
from dimlens.sources.tables import (
    header_delimiter,
    header_lines,
    path_exists,
    read_table,
    row_number_in_file,
)

# Names in the file format.
MANIFEST = "datapackage.json"
INDEX_MEMBER = "ddfSchema"
TRANSLATION_FOLDER = "lang"
DELIMITED, PARQUET = "csv", "parquet"

_ENTRY = "array<struct<primaryKey:string,value:string,resources:array<string>>>"
_SCHEMA = (
    "resources array<struct<name:string,path:string,format:string,data:array<map<string,string>>,"
    "dialect:struct<delimiter:string,multiline:boolean>,"
    "schema:struct<primaryKey:string,fields:array<struct<name:string>>>>>, "
    "translations array<struct<id:string>>, "
    f"{INDEX_MEMBER} struct<" + ",".join(f"{c}:{_ENTRY}" for c in COLLECTIONS) + ">"
)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest as one row. A key may be written as text or as a list."""
    return spark.read.schema(_SCHEMA).json(f"{folder}/{MANIFEST}", multiLine=True)


def manifest_from(spark: SparkSession, text: str) -> DataFrame:
    """The manifest given as text, as one row."""
    return parse_manifests(spark.createDataFrame([(text,)], "value string"))


def parse_manifests(texts: DataFrame) -> DataFrame:
    """One row per text of the only column, each the text of a manifest."""
    parsed = F.from_json(F.col(f"`{texts.columns[0]}`"), _SCHEMA)
    return texts.select(parsed.alias("m")).select("m.*")


def manifest_resources(manifest: DataFrame) -> DataFrame:
    """``(place, name, path, format, data, delimiter, multiline, key, columns)`` in manifest order."""
    return manifest.select(F.posexplode("resources").alias("place", "r")).select(
        "place",
        "r.name",
        "r.path",
        F.coalesce("r.format", F.lit(DELIMITED)).alias("format"),
        "r.data",
        F.col("r.dialect.delimiter").alias("delimiter"),
        F.col("r.dialect.multiline").alias("multiline"),
        F.col("r.schema.fields.name").alias("columns"),
        _key_list(F.col("r.schema.primaryKey")).alias("key"),
    )


def manifest_index(manifest: DataFrame) -> DataFrame:
    """``(kind, place, key, value, resources)`` of the availability index."""
    views = [
        manifest.select(
            F.lit(kind).alias("kind"), F.posexplode(f"{INDEX_MEMBER}.{kind}").alias("place", "e")
        ).select("kind", "place", _key_list(F.col("e.primaryKey")).alias("key"),
                 "e.value", "e.resources")
        for kind in COLLECTIONS
    ]
    return functools.reduce(DataFrame.unionByName, views)


def open_folder(
    spark: SparkSession,
    folder: str,
    name: str | None = None,
    multiline: bool = True,
    unique_keys: bool = False,
    manifest: str | None = None,
) -> Dataset:
    """The dataset in a folder. Files are opened when a query needs them.

    The manifest, in the folder or given as text, says for each resource its format (delimited
    text or Parquet, which may be partitioned), its columns and delimiter, and whether cells hold
    line breaks; ``multiline`` stands in where it does not. A small resource may stand in it as
    ``data``, a list of objects. Delimited files alike in key, columns
    and dialect are read by one scan, however many there are. With ``unique_keys`` the keys of each
    file are taken to be unique, as the manifest says, and no row order is tracked.
    """
    folder = folder.rstrip("/")
    given = read_manifest(spark, folder) if manifest is None else manifest_from(spark, manifest)
    languages = [
        row.id
        for row in given.select(F.explode("translations").alias("t")).select("t.id").collect()
    ]
    resources, translations = [], Translations(spark, folder)
    for row in manifest_resources(given).orderBy("place").collect():
        if row.format not in (DELIMITED, PARQUET):
            raise DatasetError(f"resource {row.name} has the unknown format {row.format}")
        key, path = tuple(row.key), f"{folder}/{row.path}"
        dialect = (row.delimiter, multiline if row.multiline is None else row.multiline)
        open_table = functools.partial(
            read_table, spark, delimiter=dialect[0], multiline=dialect[1]
        )
        columns = tuple(row.columns) if row.columns else None
        if row.data is not None:
            source = _inline(spark, row.data)
        elif row.format == PARQUET:
            source = functools.partial(spark.read.parquet, path)
        else:
            source = functools.partial(open_table, path, columns=columns)
        alike = row.data is None and row.format == DELIMITED and columns and dialect[0]
        resources.append(Resource(
            row.name,
            key,
            source,
            {
                language: functools.partial(translations.table, language, row.path, *dialect)
                for language in languages
            },
            columns and tuple(c for c in columns if c not in key),
            row_order=None if unique_keys or row.data is not None else row_number_in_file(),
            unique=unique_keys,
            scan=TableScan(spark, folder, key, columns, *dialect, translations) if alike else None,
            path=row.path,
        ))
    index = [
        IndexEntry(row.kind, tuple(row.key), row.value, tuple(row.resources))
        for row in manifest_index(given).collect()
    ]
    return Dataset(spark, resources, index, name or folder.rsplit("/", 1)[-1], folder=folder)


class Translations:
    """The translation files of a folder. A language's files are listed once, with their headers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._headers: dict[str, dict[str, str]] = {}

    def base(self, language: str) -> str:
        return f"{self.folder}/{TRANSLATION_FOLDER}/{language}"

    def headers(self, language: str) -> dict[str, str]:
        """The first line of each file, by its path below the language's folder."""
        if language not in self._headers:
            self._headers[language] = header_lines(self.spark, self.base(language))
        return self._headers[language]

    def tables(
        self, language: str, places: Mapping[str, int], delimiter: str | None, multiline: bool
    ) -> list[DataFrame]:
        """Translated cells of the tables at the given paths, each row marked with its table's place.

        Files with the same header are one scan. A table is a file, or a folder of part files;
        one without a translation has no rows.
        """
        groups: dict[tuple, dict[str, int]] = {}
        for file, line in self.headers(language).items():
            place = places.get(file, places.get(file.rpartition("/")[0]))
            if place is not None:
                used = delimiter or header_delimiter(line, file)
                columns = tuple(next(csv.reader([line], delimiter=used)))
                groups.setdefault((used, columns), {})[file] = place
        return [
            marked_tables(self.spark, self.base(language), files, used, multiline, columns)
            for (used, columns), files in groups.items()
        ]

    def table(
        self, language: str, path: str, delimiter: str | None, multiline: bool
    ) -> DataFrame | None:
        """Translated cells of one table, None without any."""
        frames = [t.drop(RESOURCE) for t in self.tables(language, {path: 0}, delimiter, multiline)]
        if not frames:
            return None
        return functools.reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
        )


def marked_tables(
    spark: SparkSession,
    base: str,
    places: Mapping[str, int],
    delimiter: str,
    multiline: bool,
    columns: Sequence[str],
) -> DataFrame:
    """Rows of the tables at the given paths below ``base``, each marked with its table's place."""
    rows = read_table(spark, [f"{base}/{p}" for p in places], delimiter, multiline, columns)
    file = F.substring_index(F.col("_metadata.file_path"), quote(urlparse(base).path) + "/", -1)
    known = F.create_map(*[F.lit(x) for p, i in places.items() for x in (quote(p), i)])
    # A table is a file, or a folder of part files.
    place = F.coalesce(known[file], known[F.regexp_replace(file, "/[^/]*$", "")])
    return rows.withColumn(RESOURCE, place)


@dataclass(frozen=True)
class TableScan:
    """What delimited files have in common that one scan can read."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    delimiter: str
    multiline: bool
    translations: Translations

    def open(self, places: Mapping[str, int]) -> DataFrame:
        """Rows of the tables at the given paths, each marked with the place of its table."""
        return marked_tables(
            self.spark, self.folder, places, self.delimiter, self.multiline, self.columns
        )

    def translated(self, language: str, places: Mapping[str, int]) -> list[DataFrame]:
        """Their translated cells, marked likewise."""
        return self.translations.tables(language, places, self.delimiter, self.multiline)


def open_version(
    spark: SparkSession,
    base: str,
    versions: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    default: Version | None = None,
    dataset: str | None = None,
    branch: str | None = None,
    commit: str | None = None,
    **options,
) -> Dataset:
    """The dataset at ``base`` itself, or else the registered version below it."""
    if options.get("manifest") or path_exists(spark, f"{base.rstrip('/')}/{MANIFEST}"):
        return open_folder(spark, base, dataset, **options)
    if not versions or default is None:
        raise DatasetError(f"no manifest at {base} and no registry of versions given")
    catalog = flatten_catalog(registry_from(spark, versions), default)
    version = resolve_version(catalog, default, dataset, branch, commit)
    return open_folder(spark, version.path(base), version.dataset, **options)


def manifest_text(
    resources: Sequence[Resource],
    index: Sequence[IndexEntry],
    paths: Mapping[str, str],
    languages: Sequence[str] = (),
) -> str:
    """The manifest file for resources stored at ``paths``."""
    return json.dumps({
        "resources": [
            {
                "name": r.name, "path": paths[r.name],
                "dialect": {"delimiter": ","},
                "schema": {"primaryKey": list(r.key),
                           "fields": [{"name": c} for c in r.frame.columns]},
            }
            for r in resources
        ],
        "translations": [{"id": language} for language in languages],
        INDEX_MEMBER: {
            kind: [
                {"primaryKey": list(e.key), "value": e.value, "resources": list(e.resources)}
                for e in index
                if e.kind == kind
            ]
            for kind in COLLECTIONS
        },
    })


def _inline(spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    names = list(dict.fromkeys(name for row in rows for name in row))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return small_table(spark, schema, [tuple(row.get(name) for name in names) for row in rows])


def _key_list(key):
    """Key parts of a manifest key: JSON text of a list, or one name."""
    return F.when(key.startswith("["), F.from_json(key, "array<string>")).otherwise(F.array(key))
