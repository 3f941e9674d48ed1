"""Lines repeated across documents, dropped everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimlens.llm.membership import separated
from dimlens.llm.storage import stored, texts

#: White space at the ends of a line, and the letters that are lower-cased.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS = 64


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def _with_content(documents: DataFrame) -> DataFrame:
    """Texts with a hash of their content, which tells apart rows that share a doc_id."""
    return texts(documents).withColumn("content", F.xxhash64("text"))


def _lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, content, position, a, b) of the lines long enough; a and b hash the line's key."""
    lines = _with_content(documents).select(
        "doc_id", "content", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    lines = lines.select("doc_id", "content", "position",
                         F.btrim("line", F.lit(WHITE_SPACE)).alias("key"))
    key = lower_ascii(F.col("key"))
    return lines.where(F.char_length("key") >= least_chars).select(
        "doc_id", "content", "position",
        F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def keep_bitmaps(documents: DataFrame, least_chars: int = 40, least_documents: int = 5) -> DataFrame:
    """(doc_id, content, keep, n_dropped) for each document that loses a line.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``least_chars`` code points found in at least ``least_documents`` documents lose all
    their lines except those in the largest doc_id that holds the key. ``keep`` holds the bits of
    64 lines in each word, one for a line that stays; words that keep all their lines are left out.

    Only hashes of 128 bits travel. They are range-partitioned by hash and document, so that a
    frequent line spreads over as many partitions as it fills, and are sorted there by document
    and position. First occurrences are streamed off that order, one for each document, and what a
    partition found about a key is combined before the shuffle.

    Rows that share a doc_id count as one document, but each keeps lines by its own text, which
    ``content`` (a hash of it) tells apart. Rows without a doc_id count together as one document
    below all others. A null text is one empty line; an empty table gives an empty result.
    """
    lines = stored(_lines(documents, least_chars), "lines")
    # The window's partitions are those of the range partitioning, and its order is theirs.
    document = Window.partitionBy("a", "b", "doc_id").orderBy("position")
    first = lines.repartitionByRange("a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id", "position").withColumn(
        "occurrence", F.row_number().over(document)).where("occurrence = 1")
    repeated = first.groupBy("a", "b").agg(
        F.count("*").alias("documents"), F.max("doc_id").alias("last")).where(
        F.col("documents") >= least_documents).select("a", "b", "last")
    dropped = lines.join(stored(repeated, "repeated"), ["a", "b"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("last")))
    words = dropped.groupBy("doc_id", "content", F.expr(f"position div {BITS}").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(position % {BITS} as int)))").alias("bits"))
    return words.groupBy("doc_id", "content").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("bits")).alias("n_dropped"))


def kept_text(text: str, keep: str) -> Column:
    """The lines of a text that its bitmap keeps, joined again; without a bitmap the text itself."""
    return F.expr(f"""if({keep} is null, {text}, array_join(filter(split({text}, '\\n'), (line, i) ->
        getbit(coalesce(map_from_entries({keep})[cast(i div {BITS} as bigint)], -1L), i % {BITS}) = 1),
        '\\n'))""")


def dedup_lines(documents: DataFrame, least_chars: int = 40, least_documents: int = 5) -> DataFrame:
    """The documents without their repeated lines; see ``keep_bitmaps``.

    One row per row of documents, with all its columns, and with n_lines before dropping and
    n_dropped, which replace columns of these names. Only documents that lose a line move to meet
    their bitmaps, and the few that ``separated`` takes for such.
    """
    bitmaps = stored(keep_bitmaps(documents, least_chars, least_documents), "bitmaps")

    def content(prefix: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(f"{prefix}text"), F.lit("")))

    losing, whole = separated(documents, lambda p: F.xxhash64(F.col(f"{p}doc_id"), content(p)),
                              bitmaps.select(F.xxhash64("doc_id", "content").alias("hash")))
    joined = losing.alias("d").join(bitmaps.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
                                    & (content("d.") == F.col("b.content")), "left")

    def result(rows: DataFrame, text: Column, dropped: Column) -> DataFrame:
        return rows.select(
            *(text.alias("text") if c == "text" else F.col(f"d.`{c}`")
              for c in documents.columns if c not in ("n_lines", "n_dropped")),
            F.size(F.split(F.coalesce(F.col("d.text"), F.lit("")), "\n")).cast("long").alias("n_lines"),
            dropped.cast("long").alias("n_dropped"))

    kept = kept_text("coalesce(d.text, '')", "b.keep")
    return result(joined, kept, F.coalesce("b.n_dropped", F.lit(0))).unionByName(
        result(whole.alias("d"), F.coalesce(F.col("d.text"), F.lit("")), F.lit(0)))
