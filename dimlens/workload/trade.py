"""The sales tables as a dimensional dataset.

Domain ``geo`` has the sets ``country`` (nations) and ``world_region`` (regions); domain
``customer`` has one set per market segment. Line items shrink to one row per supplier and year
before they meet a dimension table, so that the join moves sums instead of rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.model import Dataset, Resource
from dimlens.operators.predicates import Bounds, IdJoin, semi_join
from dimlens.session import small_table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TRANSLATED = "nl-nl"
CORRECTED_REGION = "ASIA"

CONCEPTS = [
    ("geo", "entity_domain", None),
    ("country", "entity_set", "geo"),
    ("world_region", "entity_set", "geo"),
    ("customer", "entity_domain", None),
    *[(segment.lower(), "entity_set", "customer") for segment in SEGMENTS],
    ("segment", "entity_domain", None),
    ("time", "time", None),
    ("name", "string", None),
    ("home", "string", None),
    ("balance", "measure", None),
    ("order_count", "measure", None),
    ("order_cents", "measure", None),
    ("shipped_qty", "measure", None),
    ("event_count", "measure", None),
    ("top_segment", "string", None),
    ("domain", "string", None),
]


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only its schema is remembered, so that its footer is read once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def year(column: str):
    return F.year(column).cast("string").alias("time")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def dated(rows: DataFrame, column: str, bounds: Mapping[str, Bounds]) -> DataFrame:
    """Rows of the years that the bounds on ``time`` allow, as a range on the date itself.

    The range reaches the scan, where a condition on the year computed from the date could not.
    """
    time = bounds.get("time", Bounds())
    for text, compare, shift in ((time.low, ">=", 0), (time.high, "<", 1)):
        if text and re.fullmatch(r"[12]\d{3}", text):
            rows = rows.filter(f"{column} {compare} timestamp '{int(text) + shift}-01-01 00:00:00'")
    return rows


def nations(spark, sf_dir) -> DataFrame:
    """``(n_nationkey, country)``."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))


def countries(spark, sf_dir) -> DataFrame:
    """``(n_nationkey, country, world_region)``."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("world_region")
    )


def customer_years(spark, sf_dir, bounds, customers=None) -> DataFrame:
    """``(o_custkey, time, order_count, order_cents)``, of some customers if their ids are given."""
    orders = dated(table(spark, sf_dir, "orders"), "o_orderdate", bounds)
    if customers is not None:
        orders = semi_join(orders, IdJoin("o_custkey", customers))
    return orders.groupBy("o_custkey", year("o_orderdate")).agg(
        F.count("*").alias("order_count"), F.sum(cents("o_totalprice")).alias("order_cents")
    )


def nation_years(spark, sf_dir, bounds, by=(), condition=None, places=nations) -> DataFrame:
    """Order counts and values per nation, year and the customer columns ``by``.

    Customers have few orders a year, so orders meet their customer as they are: one shuffle at
    most, in which Spark splits a customer that holds most of them.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", *by)
    orders = dated(table(spark, sf_dir, "orders"), "o_orderdate", bounds)
    if condition is not None:
        orders = orders.filter(condition)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", *by, year("o_orderdate"))
        .agg(F.count("*").alias("order_count"), F.sum(cents("o_totalprice")).alias("order_cents"))
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def orders_by_country(spark, sf_dir, bounds) -> DataFrame:
    return nation_years(spark, sf_dir, bounds).select("country", "time", "order_count")


def orders_by_region(spark, sf_dir, bounds) -> DataFrame:
    rows = nation_years(spark, sf_dir, bounds, places=countries)
    return rows.groupBy("world_region", "time").agg(F.sum("order_count").alias("order_count"))


def corrections(spark, sf_dir, bounds) -> DataFrame:
    """A later file: in one region, only fulfilled orders count."""
    fulfilled = "o_orderstatus = 'F'"
    rows = nation_years(spark, sf_dir, bounds, condition=fulfilled, places=countries)
    return rows.filter(F.col("world_region") == CORRECTED_REGION).select(
        "country", "time", "order_count"
    )


def orders_by_segment(spark, sf_dir, bounds) -> DataFrame:
    return nation_years(spark, sf_dir, bounds, by=["c_mktsegment"]).select(
        "country", F.col("c_mktsegment").alias("segment"), "time", "order_count", "order_cents"
    )


def spending(spark, sf_dir, bounds) -> DataFrame:
    """Four dimensions."""
    orders = dated(table(spark, sf_dir, "orders"), "o_orderdate", bounds)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.col("c_mktsegment").alias("segment"),
                 F.col("o_orderpriority").alias("priority"), year("o_orderdate"))
        .agg(F.sum(cents("o_totalprice")).alias("spent_cents"))
        .join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("country", "segment", "priority", "time", "spent_cents")
    )


def shipments_by_country(spark, sf_dir, bounds) -> DataFrame:
    lines = dated(table(spark, sf_dir, "lineitem"), "l_shipdate", bounds)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.groupBy("l_suppkey", year("l_shipdate"))
        .agg(F.sum("l_quantity").cast("bigint").alias("shipped_qty"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "time")
        .agg(F.sum("shipped_qty").alias("shipped_qty"))
        .join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("country", "time", "shipped_qty")
    )


def events_by_country(spark, sf_dir, bounds) -> DataFrame:
    """Events by the country of their customer; they lie in other years than the orders."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        dated(table(spark, sf_dir, "events"), "ts", bounds)
        .groupBy("user_id", year("ts")).agg(F.count("*").alias("event_count"))
        .join(customer, F.col("user_id") == F.col("c_custkey"))
        .groupBy("c_nationkey", "time").agg(F.sum("event_count").alias("event_count"))
        .join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("country", "time", "event_count")
    )


def customer_orders(spark, sf_dir, bounds, ids=None) -> DataFrame:
    rows = customer_years(spark, sf_dir, bounds, customers=(ids or {}).get("customer"))
    return rows.withColumnRenamed("o_custkey", "customer")


def country_entities(spark, sf_dir) -> DataFrame:
    return countries(spark, sf_dir).select(
        "country", F.initcap("country").alias("name"), "world_region",
        F.lit(True).alias("is--country"),
    )


def region_entities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("world_region"), F.initcap("r_name").alias("name"),
        F.lit(True).alias("is--world_region"),
    )


def customer_entities(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("home"),
        F.col("c_acctbal").alias("balance"),
        *[(F.col("c_mktsegment") == s).alias(f"is--{s.lower()}") for s in SEGMENTS],
    )


def country_translations(spark, sf_dir) -> DataFrame:
    """Translated names, empty for the short ones."""
    name = F.when(F.length("country") > 8, F.concat(F.lit("nl-"), "country")).otherwise("")
    return countries(spark, sf_dir).select("country", name.alias("name"))


def concept_rows(spark, rows=None) -> DataFrame:
    names = ("concept", "concept_type", "domain")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return small_table(spark, schema, rows or CONCEPTS)


ENTITIES = {
    "country_entities": ("country", country_entities, ("name", "world_region", "is--country")),
    "region_entities": ("world_region", region_entities, ("name", "is--world_region")),
    "customer_entities": ("customer", customer_entities, (
        "name", "home", "balance", *[f"is--{s.lower()}" for s in SEGMENTS])),
}
DATAPOINTS = {
    "orders_by_country": (("country", "time"), orders_by_country, ("order_count",)),
    "shipments_by_country": (("country", "time"), shipments_by_country, ("shipped_qty",)),
    "events_by_country": (("country", "time"), events_by_country, ("event_count",)),
    "orders_by_region": (("world_region", "time"), orders_by_region, ("order_count",)),
    "corrections": (("country", "time"), corrections, ("order_count",)),
    "orders_by_segment": (("country", "segment", "time"), orders_by_segment,
                          ("order_count", "order_cents")),
    "customer_orders": (("customer", "time"), customer_orders, ("order_count", "order_cents")),
}


def trade_dataset(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    """The dataset with the named resources, or with all of them; each is built when used."""
    resources = [Resource("concepts", ("concept",), concept_rows(spark))]
    for name, (key, build, columns) in ENTITIES.items():
        build = functools.partial(build, spark, sf_dir)
        translations = {}
        if name == "country_entities":
            translations[TRANSLATED] = functools.partial(country_translations, spark, sf_dir)
        resources.append(Resource(name, (key,), build, translations, columns, unique=True))
    for name, (key, build, columns) in DATAPOINTS.items():
        build = functools.partial(build, spark, sf_dir)
        source = functools.partial(build, {})
        resources.append(
            Resource(name, key, source, columns=columns, unique=True, bounded=build,
                     limited_by=("customer",) if build.func is customer_orders else ())
        )
    chosen = [r for r in resources if not names or r.name in ("concepts", *names)]
    return Dataset(spark, chosen, name="trade", disjoint=True)


# The same resources in SQL, for the comparison queries.
SQL = """
WITH countries AS (
  SELECT n_nationkey, n_name AS country, r_name AS world_region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
placed AS (
  SELECT country, world_region, c_custkey AS customer, c_mktsegment AS segment,
         CAST(year(o_orderdate) AS VARCHAR) AS time, o_orderstatus AS status,
         o_orderpriority AS priority,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN countries ON c_nationkey = n_nationkey),
by_country AS (
  SELECT country, time, count(*) AS order_count FROM placed GROUP BY ALL),
by_region AS (
  SELECT world_region, time, count(*) AS order_count FROM placed GROUP BY ALL),
corrections AS (
  SELECT country, time, count(*) AS order_count FROM placed
  WHERE status = 'F' AND world_region = 'ASIA' GROUP BY ALL),
by_segment AS (
  SELECT country, segment, time, count(*) AS order_count,
         CAST(sum(cents) AS BIGINT) AS order_cents
  FROM placed GROUP BY ALL),
spending AS (
  SELECT country, segment, priority, time, CAST(sum(cents) AS BIGINT) AS spent_cents
  FROM placed GROUP BY ALL),
by_customer AS (
  SELECT customer, time, count(*) AS order_count, CAST(sum(cents) AS BIGINT) AS order_cents
  FROM placed GROUP BY ALL),
shipments AS (
  SELECT country, CAST(year(l_shipdate) AS VARCHAR) AS time,
         CAST(sum(l_quantity) AS BIGINT) AS shipped_qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN countries ON s_nationkey = n_nationkey GROUP BY ALL),
event_counts AS (
  SELECT country, CAST(year(ts) AS VARCHAR) AS time, count(*) AS event_count
  FROM events JOIN customer ON user_id = c_custkey JOIN countries ON c_nationkey = n_nationkey
  GROUP BY ALL),
counted AS (
  SELECT country, time, coalesce(c.order_count, o.order_count) AS order_count
  FROM by_country o FULL JOIN corrections c USING (country, time)),
merged AS (
  SELECT country, time, order_count, shipped_qty
  FROM counted FULL JOIN shipments USING (country, time)),
eventful AS (
  SELECT country, time, order_count, event_count
  FROM counted FULL JOIN event_counts USING (country, time))
"""
