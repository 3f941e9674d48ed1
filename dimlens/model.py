"""The data model: resources of rows, the concepts that describe their columns, the dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.errors import DatasetError
from dimlens.functions.cells import empty_to_null, parse_boolean, parse_number, parse_number_prefix
from dimlens.functions.concepts import ENTITY_TYPES
from dimlens.functions.keys import MEMBERSHIP_PREFIX, key_text, membership_column
from dimlens.operators.merge import ROW, merge
from dimlens.operators.predicates import Bounds

if TYPE_CHECKING:
    from dimlens.sources.manifest import TableScan

CONCEPTS, ENTITIES, DATAPOINTS = "concepts", "entities", "datapoints"
COLLECTIONS = (CONCEPTS, ENTITIES, DATAPOINTS)


@dataclass(frozen=True)
class Concept:
    name: str
    type: str | None
    domain: str | None = None


@dataclass(frozen=True)
class Resource:
    """Rows under one key: a DataFrame, or a function that opens it when a query needs it.

    ``columns`` names the value columns of a resource that should not be opened to find them.
    ``row_order`` orders the rows of one key value inside the resource, so that the last one
    wins a merge. ``unique`` says that keys are complete and occur once, which
    ``reports.repeated_keys`` checks. ``bounded`` opens the resource for keys
    inside the given bounds: it lets a resource derived from larger tables skip parts of them,
    and may return rows outside the bounds. With key parts in ``limited_by`` it takes, as a second
    argument, the ids that a query allows for these parts, each as a one-column DataFrame, and
    limits its rows to them before it derives anything. Resources with an equal ``scan`` can be
    read together, by their ``path``.
    """

    name: str
    key: tuple[str, ...]
    source: DataFrame | Callable[[], DataFrame]
    translations: Mapping[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    columns: tuple[str, ...] | None = None
    row_order: Column | None = None
    unique: bool = False
    bounded: Callable[..., DataFrame] | None = None
    limited_by: tuple[str, ...] = ()
    scan: TableScan | None = None
    path: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "key", tuple(self.key))

    def rows(
        self, bounds: Mapping[str, Bounds], ids: Mapping[str, DataFrame] | None = None
    ) -> DataFrame:
        inside = {k: b for k, b in bounds.items() if k in self.key}
        wanted = {k: i for k, i in (ids or {}).items() if k in self.limited_by}
        if not self.bounded or not (inside or wanted):
            return self.frame
        return self.bounded(inside, wanted) if wanted else self.bounded(inside)

    @cached_property
    def frame(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    def translation(self, language: str) -> DataFrame | None:
        source = self.translations.get(language)
        return source() if callable(source) else source

    def ordered(self, rows: DataFrame) -> DataFrame:
        """Rows with their order, if it matters, in a column that later pruning has to keep."""
        return rows if self.row_order is None else rows.withColumn(ROW, self.row_order)

    @property
    def kind(self) -> str:
        if self.key == ("concept",):
            return CONCEPTS
        return ENTITIES if len(self.key) == 1 else DATAPOINTS

    @property
    def values(self) -> list[str]:
        if self.columns is not None:
            return list(self.columns)
        return [c for c in self.frame.columns if c not in self.key]


@dataclass(frozen=True)
class IndexEntry:
    """Availability of one value under one key, and the resources that hold it."""

    kind: str
    key: tuple[str, ...]
    value: str
    resources: tuple[str, ...]


def collect_index(availability: DataFrame) -> list[IndexEntry]:
    """Availability rows as an index: one entry per key and value, metadata in size."""
    rows = availability.orderBy("kind", "key", "value").collect()
    return [IndexEntry(r.kind, tuple(r.key), r.value, tuple(r.resources)) for r in rows]


class Dataset:
    """Resources in file order, with the index that says which of them answer a key and value.

    ``index`` may be given (a manifest has one), as entries or as a table of ``(kind, key, value,
    resources)``, which is read when a query needs more of it than its rows; otherwise it follows from the columns of the
    resources: a resource keyed by a domain answers for each of its sets, and one keyed by a set
    for its domain and, unless the sets are ``disjoint``, for the other sets of the domain.
    """

    def __init__(
        self,
        spark: SparkSession,
        resources: Sequence[Resource],
        index: Iterable[IndexEntry] | DataFrame | None = None,
        name: str = "dataset",
        disjoint: bool = False,
        folder: str | None = None,
    ):
        self.spark = spark
        self.name = name
        self.disjoint = disjoint
        self.folder = folder
        self.resources = {r.name: r for r in resources}
        if len(self.resources) != len(resources):
            raise DatasetError("resource names must be unique")
        self.index_table = index if isinstance(index, DataFrame) else None
        self._declared = None if index is None or self.index_table is not None else list(index)

    def with_index(self, index: Iterable[IndexEntry] | DataFrame) -> Dataset:
        return Dataset(
            self.spark, list(self.resources.values()), index, self.name, self.disjoint, self.folder
        )

    # --- concepts -----------------------------------------------------------------------

    def concept_table(self, columns: Sequence[str]) -> DataFrame:
        """Untyped concept rows, all concept resources merged."""
        frames = [
            r.frame.select(*[c for c in ("concept", *columns) if c in r.frame.columns])
            for r in self.resources.values()
            if r.kind == CONCEPTS
        ]
        if not frames:
            raise DatasetError(f"{self.name} has no concept table")
        table = merge(frames, ["concept"])
        missing = [c for c in columns if c not in table.columns]
        return table.withColumns({c: F.lit(None).cast("string") for c in missing})

    def lookup(self, names: Iterable[str]) -> dict[str, Concept]:
        """Concepts of the given names: the names bound what reaches the driver."""
        table = self.concept_table(["concept_type", "domain"])
        rows = (
            table.filter(F.col("concept").isin(sorted(set(names))))
            .select("concept", "concept_type", empty_to_null(F.col("domain")))
            .collect()
        )
        return {row[0]: Concept(*row) for row in rows}

    @cached_property
    def dictionary(self) -> dict[str, Concept]:
        """Concepts that name a column or key of some resource."""
        names = set()
        for resource in self.resources.values():
            names.update(resource.key)
            if self._declared is None:
                names.update(resource.values)
        for entry in self._declared or ():
            names.update(entry.key)
            names.add(entry.value)
        names.update([n.removeprefix(MEMBERSHIP_PREFIX) for n in names])
        concepts = self.lookup(names)
        for concept in list(concepts.values()):
            if concept.type == "entity_set":
                flag = membership_column(concept.name)
                concepts[flag] = Concept(flag, "boolean")
                if concept.domain:
                    concepts.setdefault(concept.domain, Concept(concept.domain, "entity_domain"))
        for name in ("concept", "concept_type"):
            concepts[name] = Concept(name, "string")
        return concepts

    def type_of(self, name: str) -> str | None:
        concept = self.dictionary.get(name)
        return concept.type if concept else None

    def domain_of(self, name: str) -> str:
        concept = self.dictionary.get(name)
        return (concept.domain if concept and concept.type == "entity_set" else None) or name

    def sets_of(self, domain: str) -> list[str]:
        return [
            c.name
            for c in self.dictionary.values()
            if c.type == "entity_set" and c.domain == domain
        ]

    def data_type(self, name: str) -> T.DataType:
        return {"measure": T.DoubleType(), "boolean": T.BooleanType()}.get(
            self.type_of(name), T.StringType()
        )

    # --- typed rows ---------------------------------------------------------------------

    def frame(self, resource: Resource, source: DataFrame | None = None) -> DataFrame:
        """Rows of a resource with text cells typed after their concepts.

        Other columns stay as they are, so that conditions on them reach the scan; empty text
        becomes null in the result.
        """
        source = resource.frame if source is None else source
        number = parse_number_prefix if resource.kind == CONCEPTS else parse_number
        parsers = {"measure": number, "boolean": parse_boolean}
        typed = {}
        for column in source.schema:
            parser = parsers.get(self.type_of(column.name))
            if parser and isinstance(column.dataType, T.StringType):
                if column.name not in resource.key:
                    typed[column.name] = parser(F.col(f"`{column.name}`"))
        return source.withColumns(typed) if typed else source

    # --- availability -------------------------------------------------------------------

    @cached_property
    def index(self) -> list[IndexEntry]:
        if self._declared is not None:
            return self._declared
        if self.index_table is not None:
            return collect_index(self.index_table)
        entries: dict[tuple, IndexEntry] = {}
        for resource in self.resources.values():
            for key in self._keys_answered(resource):
                for value in resource.values or [""]:
                    at = (key_text(key), value)
                    known = entries.get(at)
                    names = (known.resources if known else ()) + (resource.name,)
                    entries[at] = IndexEntry(resource.kind, key, value, names)
        return list(entries.values())

    def _keys_answered(self, resource: Resource) -> list[tuple[str, ...]]:
        keys = [()]
        for part in resource.key:
            names = [part]
            if self.type_of(part) in ENTITY_TYPES:
                domain = self.domain_of(part)
                others = [] if self.disjoint and part != domain else self.sets_of(domain)
                names = list(dict.fromkeys([part, domain, *others]))
            keys = [key + (name,) for key in keys for name in names if name not in key]
        return keys

    @cached_property
    def _lookup_index(self) -> dict[str, dict[str, tuple[str, ...]]]:
        table: dict[str, dict[str, tuple[str, ...]]] = {}
        for entry in self.index:
            table.setdefault(key_text(entry.key), {})[entry.value] = entry.resources
        return table

    def resolve(self, key: Sequence[str], values: Sequence[str]) -> list[Resource]:
        """Resources that answer the key, in value order and then index order, none twice.

        Without values, every resource of the key.
        """
        available = self._lookup_index.get(key_text(key), {})
        wanted = values or list(available)
        names = dict.fromkeys(n for value in wanted for n in available.get(value, ()))
        unlisted = [n for n in names if n not in self.resources]
        if unlisted:
            raise DatasetError(f"{self.name} has no resource {', '.join(unlisted)}")
        return [self.resources[n] for n in names]
