"""Documents that carry their translations: a map of properties and a map of maps by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def translate_properties(
    properties: Column, languages: Column, language: str | Column | None
) -> Column:
    """Properties overlaid with those of a language; empty text replaces too."""
    if language is None:
        return properties
    language = F.lit(language) if isinstance(language, str) else language
    overlay = F.try_element_at(languages, language)
    kept = F.map_filter(properties, lambda name, _: ~F.map_contains_key(overlay, name))
    return F.when(overlay.isNull() | (F.size(overlay) == 0), properties).otherwise(
        F.map_concat(kept, overlay)
    )
