"""Concept types and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concept types, split by the kind of values they take.
DISCRETE_TYPES = (
    "entity_set", "entity_domain", "time", "year", "week", "month", "day", "quarter",
    "string", "boolean", "interval", "role", "custom_type",
)
CONTINUOUS_TYPES = ("measure", "facet")
ENTITY_TYPES = ("entity_set", "entity_domain")


def concept_class(concept_type: Column) -> Column:
    """``discrete``, ``continuous`` or null for an unknown type."""
    return (
        F.when(concept_type.isin(*DISCRETE_TYPES), "discrete")
        .when(concept_type.isin(*CONTINUOUS_TYPES), "continuous")
    )
