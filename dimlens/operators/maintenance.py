"""Availability and statistics kept up to date from changes, without the facts they came from.

The state of a table of facts is one row per combination of the ids that belong to sets: how many
cells of each value are filled, their sum and extremes. A batch of changes, rows that came and rows
that went, shrinks to the same form before it meets the state. Only a combination that lost an
extreme has to look at facts again, and only at its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.errors import DatasetError
from dimlens.model import Dataset, Resource
from dimlens.operators.availability import Memberships, by_key_names, open_parts
from dimlens.operators.merge import filled
from dimlens.session import shared_folder

#: Measures of one value: cells filled, their sum, the least and the largest.
COUNT, TOTAL, LOW, HIGH = MEASURES = ("n", "total", "low", "high")


@dataclass(frozen=True)
class FactState:
    """The state of a resource's facts, stored in a folder; every change gives a new one.

    ``resource`` describes the facts: its key and columns; its rows are read when the state is
    built, never by a change.
    """

    dataset: Dataset
    resource: Resource
    folder: str
    number: int
    lost: int = 0

    @classmethod
    def build(cls, dataset: Dataset, resource: Resource, facts: DataFrame, folder: str | None = None) -> FactState:
        """The state of all facts. ``folder`` lies in storage shared by the cluster."""
        state = cls(dataset, resource, folder or shared_folder(dataset.spark, "facts"), 0)
        state._measured(facts).write.parquet(state.path)
        return state

    @property
    def path(self) -> str:
        return f"{self.folder}/state={self.number}"

    @property
    def rows(self) -> DataFrame:
        return self.dataset.spark.read.schema(self._schema).parquet(self.path)

    @property
    def parts(self) -> list[str]:
        """Key parts whose ids belong to sets; the others stand for their names alone."""
        return open_parts(self.dataset, self.resource.key)

    @property
    def values(self) -> list[str]:
        return list(self.resource.values)

    @functools.cached_property
    def _schema(self) -> T.StructType:
        return self._measured(self.resource.frame.limit(0)).schema

    def _measured(self, facts: DataFrame) -> DataFrame:
        facts = self.dataset.frame(self.resource, facts)
        aggregates: list[Column] = []
        for i, value in enumerate(self.values):
            cell, kind = F.col(f"`{value}`"), facts.schema[value].dataType
            held = F.when(filled(cell, kind), cell)
            number = held if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
            aggregates += [F.count(held).alias(f"{COUNT}{i}"), F.sum(number).alias(f"{TOTAL}{i}"),
                           F.min(number).alias(f"{LOW}{i}"), F.max(number).alias(f"{HIGH}{i}")]
        return facts.groupBy(*[f"`{p}`" for p in self.parts]).agg(*aggregates)

    def change(
        self, added: DataFrame, removed: DataFrame, facts: Callable[[DataFrame], DataFrame]
    ) -> FactState:
        """The state after a batch: ``added`` rows are new facts, ``removed`` ones are none any more.

        A changed fact is in both, as it was and as it is. ``facts`` gives the facts after the batch
        for some combinations of ids, a DataFrame of the state's parts; it is asked only if a
        combination lost an extreme that no new fact reaches. The state is written once, and once
        more for those combinations; states of earlier batches stay for their readers.
        """
        before, after = self.rows, FactState(self.dataset, self.resource, self.folder, self.number + 1)
        sides = {"s": before, "a": self._measured(added), "r": self._measured(removed)}
        joined, keys = None, self.parts or ["__all"]
        for name, side in sides.items():
            side = side if self.parts else side.withColumn("__all", F.lit(0))
            measures = F.struct(*[c for c in side.columns if c not in keys]).alias(name)
            # Keys may hold nulls, so sides are combined by grouping, not joined.
            side = side.select(*keys, measures)
            joined = side if joined is None else joined.unionByName(side, allowMissingColumns=True)
        met = joined.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in sides])
        cells, lost = [], F.lit(False)
        for i in range(len(self.values)):
            s, a, r = ({m: F.col(f"{side}.{m}{i}") for m in MEASURES} for side in sides)
            zero = F.lit(0)
            n = F.coalesce(s[COUNT], zero) + F.coalesce(a[COUNT], zero) - F.coalesce(r[COUNT], zero)
            total = F.coalesce(s[TOTAL], zero) + F.coalesce(a[TOTAL], zero) - F.coalesce(r[TOTAL], zero)
            numeric = F.coalesce(s[TOTAL], a[TOTAL], r[TOTAL]).isNotNull() & (n > 0)
            low, high = F.least(s[LOW], a[LOW]), F.greatest(s[HIGH], a[HIGH])
            gone = numeric & ((r[LOW] <= low) & ~F.coalesce(a[LOW] <= low, F.lit(False))
                              | (r[HIGH] >= high) & ~F.coalesce(a[HIGH] >= high, F.lit(False)))
            lost = lost | F.coalesce(gone, F.lit(False))
            cells += [n.alias(f"{COUNT}{i}"), F.when(numeric, total).alias(f"{TOTAL}{i}"),
                      F.when(numeric, low).alias(f"{LOW}{i}"), F.when(numeric, high).alias(f"{HIGH}{i}")]
        typed = [c.cast(self._schema[name].dataType).alias(name)
                 for c, name in zip(cells, [f"{m}{i}" for i in range(len(self.values)) for m in MEASURES], strict=True)]
        left = functools.reduce(Column.__or__, [F.col(f"{COUNT}{i}") > 0 for i in range(len(self.values))])
        names = [f.name for f in self._schema]
        draft = f"{self.folder}/draft={after.number}"
        met.select(*keys, *typed, lost.alias("__lost")).filter(left).select(*names, "__lost").write.parquet(draft)
        drafted = self.dataset.spark.read.schema(self._schema.add("__lost", "boolean")).parquet(draft)
        asked = drafted.filter("__lost").select(*self.parts)
        again = asked.count()
        rows = drafted.filter("NOT __lost").select(*names)
        if again:
            rows = rows.unionByName(self._measured(facts(asked)).select(*names))
        rows.write.parquet(after.path)
        return FactState(after.dataset, after.resource, after.folder, after.number, again)

    def named(self) -> DataFrame:
        """``(key, value, n, total, low, high)`` under every key that the facts' key stands for.

        Memberships are those of now: an entity that joined a set counts for it at once.
        """
        combine = {f"{m}{i}": {COUNT: F.sum, TOTAL: F.sum, LOW: F.min, HIGH: F.max}[m]
                   for i in range(len(self.values)) for m in MEASURES}
        if not combine:
            raise DatasetError(f"{self.resource.name} has no values")
        keyed = by_key_names(Memberships(self.dataset), self.rows, self.resource.key, combine)
        keyed = keyed.groupBy("key").agg(*[f(F.col(n)).alias(n) for n, f in combine.items()])
        entries = F.array(*[
            F.struct(F.lit(v).alias("value"), F.col(f"{COUNT}{i}").alias(COUNT),
                     *[F.col(f"{m}{i}").cast("double").alias(m) for m in (TOTAL, LOW, HIGH)])
            for i, v in enumerate(self.values)])
        return keyed.select("key", F.explode(entries).alias("e")).select("key", "e.*").filter(F.col(COUNT) > 0)

    def availability(self) -> DataFrame:
        """``(kind, key, value, resources)``, what ``build_availability`` finds in these facts."""
        return self.named().select(
            F.lit(self.resource.kind).alias("kind"), "key", "value",
            F.array(F.lit(self.resource.name)).alias("resources"))

    def statistics(self) -> DataFrame:
        """``(key, value, low, high, mean)`` of the values that are numbers."""
        return self.named().filter(F.col(LOW).isNotNull()).select(
            "key", "value", LOW, HIGH, (F.col(TOTAL) / F.col(COUNT)).alias("mean"))


def of_ids(facts: DataFrame, parts: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Facts of some combinations of ids, for ``FactState.change``: a semi-join on the facts."""
    def chosen(asked: DataFrame) -> DataFrame:
        ids = asked.toDF(*[f"__{p}" for p in parts]) if parts else asked
        same = [F.col(f"`{p}`").eqNullSafe(F.col(f"`__{p}`")) for p in parts]
        return facts.join(ids, functools.reduce(Column.__and__, same), "left_semi") if parts else facts

    return chosen
