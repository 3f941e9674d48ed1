"""Operators on plain tables: cells, latest rows, version differences, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.functions.cells import parse_boolean, parse_number, parse_number_prefix
from dimlens.model import Dataset, Resource
from dimlens.operators.latest import latest_per_key
from dimlens.operators.merge import STRICT, last_rows, merge
from dimlens.operators.normalize import normalize_cells
from dimlens.operators.reports import rejected_cells as rejected
from dimlens.operators.versions import apply_changes
from dimlens.operators.versions import version_diff as diff
from dimlens.session import shared_folder
from dimlens.streaming.changes import current_rows, store_changes
from dimlens.workload.registry import registered
from dimlens.workload.trade import concept_rows, table

SPLIT = "timestamp '2024-01-15 00:00:00'"


@registered("""
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
  FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY) WHERE place = 1
""")
def latest_event_per_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "event_type", "value"
    )
    return latest_per_key(events, ["user_id"], "ts", "2 days", tie_breakers=["event_id"])


@registered("""
SELECT user_id, event_type, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
    AS place FROM events) WHERE place = 1
""")
def last_row_wins(spark, sf_dir):
    """Rows that share a key collapse to the last one."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id", "value"
    )
    return last_rows(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("event_id")


@registered("""
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN NULL ELSE value END AS DOUBLE) AS number,
       CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag,
       CAST(floor(value) AS DOUBLE) AS prefix
FROM events
""")
def typed_cells(spark, sf_dir):
    """Text cells typed as numbers and booleans; what is neither becomes null."""
    kind = F.col("event_type")
    cells = _text_cells(spark, sf_dir)
    return cells.select(
        "event_id",
        parse_number(F.col("number")).alias("number"),
        parse_boolean(F.col("flag")).alias("flag"),
        parse_number_prefix(F.concat(F.floor("value").cast("string"), F.lit(" "), kind))
        .alias("prefix"),
    )


@registered("""
SELECT event_id, 'number' AS "column", props AS cell FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'flag', event_type FROM events WHERE event_type NOT IN ('click', 'view')
""")
def rejected_cells(spark, sf_dir):
    concepts = concept_rows(spark, [("number", "measure", None), ("flag", "boolean", None),
                                    ("event_id", "entity_domain", None)])
    cells = _text_cells(spark, sf_dir).select("event_id", "number", "flag")
    resource = Resource("cells", ("event_id",), cells)
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts), resource])
    return rejected(dataset, resource)


def _text_cells(spark, sf_dir):
    kind = F.col("event_type")
    number = F.when(kind == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    flag = F.when(kind == "click", "TRUE").when(kind == "view", "false").otherwise(kind)
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", number.alias("number"), flag.alias("flag")
    )


@registered("""
SELECT o_orderkey, nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '')
         AS status,
       CAST(CASE WHEN o_totalprice >= 1000 THEN floor(o_totalprice / 1000) ELSE o_totalprice END
         AS DOUBLE) AS price,
       o_orderpriority AS priority, CAST(year(o_orderdate) AS DOUBLE) AS year,
       upper(o_orderpriority) AS shout
FROM orders
""")
def normalize_text_cells(spark, sf_dir):
    """Numbers written with thousands separators keep their leading part."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.format_number("o_totalprice", 2).alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.col("o_orderpriority").alias("shout"),
    )
    return normalize_cells(orders, parsers={"shout": F.upper}, numeric=["price", "year"])


NEW_VERSION_SQL = """
WITH newer AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END
           AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice, o_orderpriority FROM orders
  WHERE o_orderpriority = '5-LOW')
"""


@registered(NEW_VERSION_SQL + """
SELECT o_orderkey, CASE WHEN o.o_orderstatus IS NULL THEN 'created'
  WHEN n.o_orderstatus IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.o_orderstatus IS NULL OR n.o_orderstatus IS NULL THEN ''
       ELSE 'o_totalprice' END AS columns
FROM orders o FULL JOIN newer n USING (o_orderkey)
WHERE o.o_orderstatus IS NULL OR n.o_orderstatus IS NULL OR o.o_totalprice <> n.o_totalprice
""")
def version_diff(spark, sf_dir):
    """Orders against a later version: some repriced, some removed, some added."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    old = table(spark, sf_dir, "orders").select(*columns)
    price = F.col("o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    kept = old.filter("o_orderstatus <> 'P'").withColumn(
        "o_totalprice", F.when(urgent, price + 1).otherwise(price)
    )
    added = old.filter("o_orderpriority = '5-LOW'").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"),
        "o_totalprice", "o_orderpriority",
    )
    return diff(old, kept.unionByName(added), ["o_orderkey"])


UPDATES_SQL = f"""
WITH ranked AS (
  SELECT *, ts >= {SPLIT} AS change,
         row_number() OVER (PARTITION BY user_id, ts >= {SPLIT} ORDER BY ts DESC, event_id DESC)
           AS place FROM events),
last AS (SELECT * FROM ranked WHERE place = 1)
SELECT user_id, event_type, value FROM last l
WHERE CASE WHEN change THEN event_type <> 'error'
      ELSE user_id NOT IN (SELECT user_id FROM last WHERE change) END
"""


def _base_and_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", "ts", "event_id"
    )
    before = events.filter(f"ts < {SPLIT}")
    base = last_rows(before, ["user_id"], ["ts", "event_id"]).drop("ts", "event_id")
    return base, _changes(events)


def _changes(events):
    return events.filter(f"ts >= {SPLIT}").withColumn("removed", F.col("event_type") == "error")


@registered(UPDATES_SQL)
def apply_updates(spark, sf_dir):
    """State per user after the updates of the second half of the stream."""
    base, changes = _base_and_changes(spark, sf_dir)
    return apply_changes(base, changes, ["user_id"], ["ts", "event_id"], "removed")


@registered(UPDATES_SQL)
def stream_updates(spark, sf_dir):
    """The same updates read as a stream and stored batch by batch."""
    base, _ = _base_and_changes(spark, sf_dir)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    stream = stream.select("user_id", "event_type", "value", "ts", "event_id")
    folder = shared_folder(spark, "updates")
    store_changes(
        _changes(stream), ["user_id"], ["ts", "event_id"],
        f"{folder}/changes", f"{folder}/checkpoint",
    ).awaitTermination()
    return current_rows(base, f"{folder}/changes", ["user_id"], ["ts", "event_id"], "removed")


@registered("""
SELECT o_orderkey, any_value(o_totalprice) AS o_totalprice, o_orderkey % 7 AS shelf,
       count(l_orderkey) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
HAVING count(l_orderkey) > 0
UNION ALL SELECT o_orderkey, o_totalprice, o_orderkey % 7, NULL, NULL FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, NULL, l_orderkey % 7, count(*), CAST(sum(l_quantity) AS BIGINT)
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
""")
def merge_order_totals(spark, sf_dir):
    """Order headers and line totals as one wide table; a shelf they disagree on would stop it."""
    shelf = (F.col("o_orderkey") % 7).alias("shelf")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", shelf)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )
    return merge([orders, lines.select("*", shelf)], ["o_orderkey"], STRICT)


@registered("""
SELECT o_orderkey, 'changed' AS change, concat_ws(',', 'o_custkey',
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'o_totalprice' END) AS columns FROM orders
""")
def version_diff_retyped(spark, sf_dir):
    """A later version that writes customer keys as text, and reprices some orders."""
    old = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1)
    new = old.withColumns({
        "o_custkey": F.col("o_custkey").cast("string"),
        "o_totalprice": price.otherwise(F.col("o_totalprice")),
    })
    return diff(old, new, ["o_orderkey"])


@registered(f"""
WITH ranked AS (
  SELECT *, ts >= {SPLIT} AS change,
         row_number() OVER (PARTITION BY user_id, ts >= {SPLIT} ORDER BY ts DESC, event_id DESC)
           AS place,
         bool_or(event_type = 'error') OVER (PARTITION BY user_id, ts >= {SPLIT}) AS closed FROM events)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type,
       CASE WHEN NOT coalesce(n.closed, false) THEN o.value END AS value
FROM (SELECT * FROM ranked WHERE place = 1 AND NOT change) o
FULL JOIN (SELECT * FROM ranked WHERE place = 1 AND change) n ON o.user_id = n.user_id
WHERE coalesce(n.event_type, '') <> 'error'
""")
def apply_partial_updates(spark, sf_dir):
    """Updates that set one column and leave the other as it was."""
    base, changes = _base_and_changes(spark, sf_dir)
    return apply_changes(base, changes.drop("value"), ["user_id"], ["ts", "event_id"], "removed")
