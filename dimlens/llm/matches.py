"""Places of pattern matches in texts, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimlens.llm.storage import stored

DOCUMENT = ("doc_id", "content")


def with_content(documents: DataFrame) -> DataFrame:
    """(doc_id, content, text): whole texts, with a hash that tells apart rows that share a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("content"), text.alias("text"))


def gaps_and_matches(text: str, pattern: Column, when: Column | None = None) -> Column:
    """struct(gaps, found): the leftmost matches that do not overlap, and the text before each.

    A match is extracted with the gap before it, the last gap with an empty match, so that the
    lengths add up to places. The pattern must not match an empty string or capture groups. Rows
    where ``when`` is false are not searched and have empty arrays.
    """
    chunk = F.concat(F.lit("(?s)(.*?)(?:("), pattern, F.lit(")|\\z)"))
    none = F.array().cast("array<string>")
    parts = [F.regexp_extract_all(F.col(text), chunk, F.lit(i)) for i in (1, 2)]
    gaps, found = (p if when is None else F.when(when, p).otherwise(none) for p in parts)
    return F.struct(gaps.alias("gaps"), found.alias("found"))


def placed(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Adds start and end, in code points, to rows with gap (its length), value and n per match.

    Rows that repeat a document give the same matches and count once. Each document's matches are
    summed up in order by a window, so a text with very many of them needs no memory of its own.
    """
    once = matched.dropDuplicates([*keys, "n"])
    order = Window.partitionBy(*keys).orderBy("n")
    size = F.char_length("value")
    return once.withColumn("end", F.sum(F.col("gap") + size).over(order).cast("long")).withColumn(
        "start", F.col("end") - size).drop("gap", "n")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["content"] == b["content"])


def rewritten(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents, each span of their texts replaced; all their columns are kept.

    ``spans`` has doc_id, content, start, end and replacement; spans of a document do not overlap.
    """
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*DOCUMENT).orderBy("start")), F.lit(0))
    own = spans.withColumn("before", before).groupBy(
        F.col("doc_id").alias("_own_id"), F.col("content").alias("_own_content")).agg(F.sort_array(
            F.collect_list(F.struct("start", "end", "before", "replacement"))).alias("_own_spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = documents.join(stored(own, "own_spans"), F.col("doc_id").eqNullSafe(F.col("_own_id"))
                            & (F.xxhash64(text) == F.col("_own_content")), "left")
    written = F.expr("""if(_own_spans is null, text, concat(array_join(transform(_own_spans, s -> concat(
        substring(text, cast(s.before + 1 as int), cast(s.start - s.before as int)), s.replacement)), ''),
        substring(text, cast(element_at(_own_spans, -1).end + 1 as int))))""")
    return joined.withColumn("text", written).select(*documents.columns)
