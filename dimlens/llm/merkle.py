"""A Merkle manifest of a dataset: a tree per group, one tree above them, and a proof per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimlens.llm.line_dedup import lower_ascii
from dimlens.llm.storage import stored

FANOUT = 8
#: Levels that are nested in one row: a block holds FANOUT**LEVELS nodes at most.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id that number the rows of a partition (Spark's format).
ROW_BITS = 33


def digest(parts: Sequence[Column]) -> Column:
    """Lower-case hex sha256 of fields, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    coded = []
    for part in parts:
        text = part.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*coded), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered_leaf) of each row; texts stay behind.

    Where 3 divides the crc32 of the id as text, the tampered leaf is that of the text with A-Z
    lower-cased; elsewhere, for rows without an id and for null texts it is the leaf.
    """
    whole = documents.select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    hashed = whole.select(
        "doc_id", "lang", digest([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(tampered, digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])).alias("other"))
    return hashed.select("doc_id", "lang", "leaf", F.coalesce("other", "leaf").alias("tampered_leaf"))


def _depth(size: Column) -> Column:
    """Levels above the nodes of a tree: the least number whose power of the fan-out reaches its size."""
    return F.coalesce(*(F.when(size <= FANOUT**k, F.lit(k)) for k in range(21)))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of (tree, …) with their rank in their tree, from 0, and the tree's depth.

    Rows are range-partitioned and sorted, so that a tree with most of the rows fills many
    partitions; what a rank lacks is the number of rows of its tree in earlier partitions, summed
    over one row per partition and tree. Rows equal in ``order`` are told apart by their place.
    """
    keys = ["tree", *order, "_row"]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = stored(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
                    .withColumn("_place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_place", ROW_BITS))
    counts = placed.groupBy("_part", "tree").agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select(
        F.col("_part").alias("_counted"), F.col("tree").alias("_tree"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"),
        _depth(F.sum("n").over(tree)).alias("depth")), "counts")
    here = (F.col("_part") == F.col("_counted")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return placed.join(counts, here).withColumn("rank", F.col("_place") + F.col("_shift")).drop(
        "_place", "_part", "_counted", "_tree", "_shift")


def _blocks(nodes: DataFrame, at: int) -> DataFrame:
    """(tree, depth, block, digest, children): LEVELS levels nested, from nodes ``at`` levels up.

    The digits of the rank are grouped away one by one, the last first; a block's rows are
    together after one exchange, and all groupings keep to it. A tree's last level is reached
    when one node remains: from there on the node is handed on as it is.
    """
    digits = [f"d{i}" for i in range(LEVELS)]
    rows = nodes.select(
        "tree", "depth", F.expr(f"rank div {FANOUT**LEVELS}").alias("block"),
        *(F.expr(f"cast(rank div {FANOUT**i} % {FANOUT} as int)").alias(d) for i, d in enumerate(digits)),
        "digest", "item")
    rows = rows.repartition("tree", "block").select(
        "tree", "depth", "block", *digits[1:], F.struct(F.col("d0").alias("place"), "digest", "item").alias("node"))
    for i in range(LEVELS):
        left = digits[i + 1:]
        rows = rows.groupBy("tree", "depth", "block", *left).agg(F.sort_array(F.collect_list("node")).alias("children"))
        joined = F.sha2(F.array_join(F.col("children.digest"), ""), 256)
        value = F.when(F.lit(at + i) < F.col("depth"), joined).otherwise(F.col("children")[0]["digest"])
        if left:
            rows = rows.select("tree", "depth", "block", *left[1:], F.struct(
                F.col(left[0]).alias("place"), value.alias("digest"), "children").alias("node"))
        else:
            rows = rows.select("tree", "depth", "block", value.alias("digest"), "children")
    return rows


def _steps(children: Column) -> Column:
    """Every child with the digests left and right of it in its run, concatenated."""
    def beside(start, length):
        return F.array_join(F.transform(F.slice(children, start, length), lambda c: c["digest"]), "")

    return F.transform(children, lambda c, i: F.struct(
        c.alias("node"), F.struct(beside(F.lit(1), i).alias("left"),
                                  beside(i + 2, F.size(children)).alias("right")).alias("step")))


def _paths(nodes: DataFrame, at: int, deepest: int, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(item, path, ends): the steps from each node up, lowest first, and the digests at their ends.

    ``nodes`` are (tree, depth, rank, digest, item). Blocks are nodes of the blocks above them,
    and what those say about a block meets it in one group of two rows. ``top`` gives path and ends
    of the nodes (tree, block, digest) that remain, one per tree.
    """
    blocks = stored(_blocks(nodes, at), "blocks")
    remaining = blocks.select("tree", "depth", "block", "digest")
    if deepest > at + LEVELS:
        upper = remaining.select("tree", "depth", F.col("block").alias("rank"), "digest",
                                 F.struct("tree", "depth", "block").alias("item"))
        above = _paths(upper, at + LEVELS, deepest, top)
    else:
        above = top(remaining)
    above = stored(above.select("item.tree", "item.depth", "item.block", "path", "ends"), "above")
    met = blocks.drop("digest").unionByName(above, allowMissingColumns=True).groupBy("tree", "depth", "block").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("children", "path", "ends")))
    for i in reversed(range(LEVELS)):
        met = met.select("depth", "path", "ends", F.explode(_steps(F.col("children"))).alias("child"))
        step = F.when(F.lit(at + i) < F.col("depth"), F.array("child.step")).otherwise(F.array())
        met = met.select("depth", F.concat(step, "path").alias("path"), "ends",
                         F.col("child.node.children") if i else F.col("child.node.item").alias("item"))
    return met.select("item", "path", "ends")


def _root_paths(subroots: DataFrame) -> DataFrame:
    """(item, path, ends) of subroots (tree, depth, block, digest): up to the root of them all."""
    def top(last: DataFrame) -> DataFrame:
        steps = F.array().cast("array<struct<left:string,right:string>>")
        return last.select(F.struct("tree", "depth", "block").alias("item"), steps.alias("path"),
                           F.array("digest").alias("ends"))

    alone = subroots.select(
        F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest",
        F.struct(F.struct("tree", "depth", "block").alias("node"), "digest").alias("item"))
    nodes = ranked(stored(alone, "subroots"), ["name"])
    found = _paths(nodes, 0, _deepest(nodes), top)
    return found.select("item.node", "path", F.concat(F.array("item.digest"), "ends").alias("ends")).withColumnRenamed(
        "node", "item")


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0] or 0


def folded(start: Column, path: Column) -> Column:
    """The root that a digest leads to: at each step its run is hashed with the digest in its place."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered_leaf, path, subroot, root), one row per row of documents.

    Leaves are ranked by doc_id within their language. While several nodes of a language remain,
    every eight consecutive ones (the last run may be shorter, even one) become the digest of their
    digests; what remains is the subroot, a lone leaf its own. Subroots, ordered by language, give
    the root in the same way. ``path`` holds, from the leaf up, the digests left and right of the
    node in its run, concatenated; see ``folded``.

    Nulls: a null field is hashed as ``-``; rows without a language are a tree of their own, the
    first; rows without an id come first in theirs. Rows that share a doc_id are ordered by their
    leaves; equal rows give equal leaves, and each has a proof of its own. An empty table gives an
    empty result. Columns other than the five hashed ones are left out. Texts are hashed where they
    are read; only digests travel, and no row ever holds more than 4096 nodes.
    """
    hashed = stored(leaves(documents), "leaves")
    nodes = ranked(hashed.select(F.col("lang").alias("tree"), "doc_id", F.col("leaf").alias("digest"),
                                 F.struct("doc_id", "lang", "leaf", "tampered_leaf").alias("item")),
                   ["doc_id", "digest"])
    found = _paths(nodes, 0, _deepest(nodes), _root_paths)
    return found.select("item.*", "path", F.col("ends")[0].alias("subroot"), F.col("ends")[1].alias("root"))
