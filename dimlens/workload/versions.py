"""Versions of the orders and customers: histories, renames, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.operators.digests import digest_diff, store_with_digests
from dimlens.operators.history import as_of, history_between, version_history, with_version
from dimlens.operators.renames import column_renames as renamed_columns
from dimlens.operators.renames import key_renames, versions_renamed
from dimlens.operators.versions import version_diff as diff
from dimlens.session import shared_folder
from dimlens.workload.registry import registered
from dimlens.workload.trade import table

# Five versions of the orders: pending ones go and come back, urgent ones are repriced, low ones go.
VERSIONS_SQL = """
WITH numbered AS (SELECT o.*, v FROM orders o, range(5) r(v)),
versions AS (
  SELECT CAST(v AS INT) AS v, o_orderkey, o_orderstatus, o_orderpriority,
         CASE WHEN o_orderpriority = '1-URGENT' AND v >= 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
  FROM numbered WHERE NOT (o_orderstatus = 'P' AND v IN (1, 2)) AND NOT (o_orderpriority = '5-LOW' AND v >= 3)),
islands AS (
  SELECT *, v - row_number() OVER (PARTITION BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice ORDER BY v)
    AS island FROM versions),
history AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, min(v) AS valid_from,
         CASE WHEN max(v) < 4 THEN max(v) + 1 END AS valid_until
  FROM islands GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, island)
"""
KEY = ["o_orderkey"]


def _version(orders, number):
    price = F.col("o_totalprice")
    if number >= 2:
        price = F.when(F.col("o_orderpriority") == "1-URGENT", price + 1).otherwise(price)
    rows = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", price.alias("o_totalprice"))
    if number in (1, 2):
        rows = rows.filter("o_orderstatus <> 'P'")
    return rows.filter("o_orderpriority <> '5-LOW'") if number >= 3 else rows


def _versions(spark, sf_dir):
    return [_version(table(spark, sf_dir, "orders"), n) for n in range(5)]


def _stored_history(spark, sf_dir):
    """The first three versions at once, the others added one by one."""
    versions = _versions(spark, sf_dir)
    folder = shared_folder(spark, "history")
    version_history(versions[:3], KEY).write.parquet(f"{folder}/2")
    for number in (3, 4):
        before = spark.read.parquet(f"{folder}/{number - 1}")
        with_version(before, versions[number], number, KEY).write.parquet(f"{folder}/{number}")
    return spark.read.parquet(f"{folder}/4")


@registered(VERSIONS_SQL + "SELECT * FROM history")
def version_history_intervals(spark, sf_dir):
    return version_history(_versions(spark, sf_dir), KEY)


@registered(VERSIONS_SQL + "SELECT * FROM history")
def version_history_extended(spark, sf_dir):
    """The same history, to which versions were added one by one."""
    return _stored_history(spark, sf_dir)


@registered(VERSIONS_SQL + "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM versions WHERE v = 2")
def as_of_version(spark, sf_dir):
    return as_of(_stored_history(spark, sf_dir), 2)


@registered(VERSIONS_SQL + """
SELECT o_orderkey, o_totalprice, 'began' AS change, valid_from AS version FROM history WHERE valid_from BETWEEN 2 AND 3
UNION ALL SELECT o_orderkey, o_totalprice, 'ended', valid_until FROM history WHERE valid_until BETWEEN 2 AND 3
""")
def version_events(spark, sf_dir):
    """What began and ended in the third and fourth version."""
    return history_between(version_history(_versions(spark, sf_dir), KEY), 1, 3).select(
        "o_orderkey", "o_totalprice", "change", "version")


RENAMED_SQL = """
WITH newer AS (
  SELECT CASE WHEN c_custkey % 9 = 4 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_name,
         c_nationkey, CASE WHEN c_custkey % 18 = 4 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL SELECT c_custkey + 100000000, 'New ' || c_name, c_nationkey, -c_acctbal - 20000, c_mktsegment
  FROM customer WHERE c_custkey % 40 = 3)
"""


def _customers(spark, sf_dir):
    """Customers, and a version in which some are renamed, some of those changed, some go, some come."""
    old = table(spark, sf_dir, "customer")
    number = F.col("c_custkey")
    kept = old.filter("c_custkey % 50 <> 7").withColumns({
        "c_acctbal": F.when(number % 18 == 4, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")),
        "c_custkey": F.when(number % 9 == 4, -number).otherwise(number)})
    came = old.filter("c_custkey % 40 = 3").withColumns({
        "c_name": F.concat(F.lit("New "), "c_name"), "c_acctbal": -F.col("c_acctbal") - 20000,
        "c_custkey": number + 100_000_000})
    return old, kept.unionByName(came)


@registered("""
SELECT c_custkey AS old_key, -c_custkey AS new_key FROM customer WHERE c_custkey % 9 = 4 AND c_custkey % 50 <> 7
""")
def version_renames(spark, sf_dir):
    """Renamed customers are told by their names and balances, not by segments that many share."""
    return key_renames(*_customers(spark, sf_dir), "c_custkey", least=0.3).select("old_key", "new_key")


@registered(RENAMED_SQL + """,
older AS (
  SELECT CASE WHEN c_custkey % 9 = 4 AND c_custkey % 50 <> 7 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_acctbal
  FROM customer)
SELECT c_custkey, CASE WHEN o.c_acctbal IS NULL THEN 'created' WHEN n.c_acctbal IS NULL THEN 'removed'
  ELSE 'changed' END AS change,
  CASE WHEN o.c_acctbal IS NULL OR n.c_acctbal IS NULL THEN '' ELSE 'c_acctbal' END AS columns
FROM older o FULL JOIN newer n USING (c_custkey) WHERE o.c_acctbal IS DISTINCT FROM n.c_acctbal
""")
def version_diff_renamed(spark, sf_dir):
    """The difference that is left once renamed customers are known."""
    old, new = _customers(spark, sf_dir)
    renames = key_renames(old, new, "c_custkey", least=0.3)
    return diff(versions_renamed(old, new, "c_custkey", renames), new, ["c_custkey"])


@registered("""
SELECT * FROM (VALUES ('o_totalprice', 'price'), ('o_orderpriority', 'urgency')) t(old_column, new_column)
WHERE EXISTS (SELECT 1 FROM orders)
""")
def version_column_renames(spark, sf_dir):
    """Columns that came back under another name; a third one is new, a fourth went."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")
    new = old.select("o_orderkey", F.col("o_orderpriority").alias("urgency"),
                     F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(F.col("o_totalprice")).alias("price"),
                     F.lit("x").alias("extra"))
    return renamed_columns(old, new, ["o_orderkey"]).select("old_column", "new_column")


@registered("""
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 1 THEN 'removed' ELSE 'changed' END AS change,
       CASE WHEN o_orderkey % 97 = 1 THEN '' ELSE 'o_totalprice' END AS columns
FROM orders WHERE o_orderkey % 97 IN (1, 2)
UNION ALL SELECT -o_orderkey - 1, 'created', '' FROM orders WHERE o_orderkey % 97 = 3
""")
def version_diff_by_digests(spark, sf_dir):
    """Two stored versions of the orders, of which only parts with differing digests are read."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    old = table(spark, sf_dir, "orders").select(*columns)
    rest = F.col("o_orderkey") % 97
    new = old.filter(rest != 1).withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(rest == 2, 1).otherwise(0))
    came = old.filter(rest == 3).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    folder = shared_folder(spark, "digests")
    store_with_digests(old, ["o_orderkey"], f"{folder}/old")
    store_with_digests(new.unionByName(came), ["o_orderkey"], f"{folder}/new")
    return digest_diff(spark, f"{folder}/old", f"{folder}/new", ["o_orderkey"])
