"""Availability, statistics and reports on the trade dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.functions.keys import canonical_key, set_name
from dimlens.model import Dataset, Resource
from dimlens.operators.availability import build_availability
from dimlens.operators.maintenance import FactState, of_ids
from dimlens.operators.quantiles import quantiles, value_sketches
from dimlens.operators.reports import dataset_sizes
from dimlens.operators.reports import merge_conflicts as conflict_report
from dimlens.operators.reports import repeated_keys
from dimlens.plans.query import query
from dimlens.session import shared_folder
from dimlens.workload.registry import registered
from dimlens.workload.trade import (
    CONCEPTS,
    SEGMENTS,
    SQL,
    TRANSLATED,
    cents,
    concept_rows,
    table,
    trade_dataset,
    year,
)

# Pairs that exist in the data, with the resources that hold them.
PAIRS = SQL + """,
segments AS (
  SELECT lower(c_mktsegment) AS segment, * FROM customer),
pairs AS (
  SELECT 'datapoints' AS kind, unnest(['country,time', 'geo,time']) AS key, 'order_count' AS value,
         'orders_by_country' AS resource FROM by_country
  UNION SELECT 'datapoints', unnest(['country,time', 'geo,time']), 'shipped_qty',
         'shipments_by_country' FROM shipments
  UNION SELECT 'datapoints', unnest(['country,time', 'geo,time']), 'event_count',
         'events_by_country' FROM event_counts
  UNION SELECT 'datapoints', unnest(['time,world_region', 'geo,time']), 'order_count',
         'orders_by_region' FROM by_region
  UNION SELECT 'datapoints', unnest(['country,time', 'geo,time']), 'order_count',
         'corrections' FROM corrections
  UNION SELECT 'datapoints', key, value, 'orders_by_segment'
         FROM by_segment, unnest(['country,segment,time', 'geo,segment,time']) AS k(key),
              unnest(['order_count', 'order_cents']) AS v(value)
  UNION SELECT DISTINCT 'datapoints', CASE WHEN 'time' < segment THEN 'time,' || segment
                                 ELSE segment || ',time' END, value, 'customer_orders'
         FROM by_customer JOIN segments ON customer = c_custkey,
              unnest(['order_count', 'order_cents']) AS v(value)
  UNION SELECT 'datapoints', 'customer,time', value, 'customer_orders'
         FROM by_customer, unnest(['order_count', 'order_cents']) AS v(value)
  UNION SELECT 'entities', key, value, 'country_entities' FROM countries,
         unnest(['country', 'geo']) AS k(key),
         unnest(['name', 'world_region', 'is--country']) AS v(value)
  UNION SELECT 'entities', key, value, 'region_entities' FROM region,
         unnest(['world_region', 'geo']) AS k(key),
         unnest(['name', 'is--world_region']) AS v(value)
  UNION SELECT DISTINCT 'entities', key, value, 'customer_entities' FROM (
         SELECT segment AS key FROM segments UNION SELECT 'customer') keys,
         unnest(['name', 'home', 'balance', 'is--automobile', 'is--building', 'is--furniture',
                 'is--household', 'is--machinery']) AS v(value)
  UNION SELECT 'concepts', 'concept', unnest(['concept_type', 'domain']), 'concepts'),
places AS (
  SELECT * FROM (VALUES ('concepts', 0), ('country_entities', 1), ('region_entities', 2),
    ('customer_entities', 3), ('orders_by_country', 4), ('shipments_by_country', 5),
    ('events_by_country', 6), ('orders_by_region', 7), ('corrections', 8),
    ('orders_by_segment', 9), ('customer_orders', 10)) p(resource, place))
"""

# Statistics per key and value over the merged data.
STATISTICS = SQL + """,
geo_counts AS (
  SELECT country AS geo, 'country' AS part, time, order_count FROM counted
  UNION ALL SELECT world_region, 'world_region', time, order_count FROM by_region),
cells AS (
  SELECT key, 'order_count' AS value, CAST(order_count AS DOUBLE) AS cell
  FROM geo_counts, unnest(['geo,time', CASE part WHEN 'country' THEN 'country,time'
                           ELSE 'time,world_region' END]) AS k(key)
  UNION ALL SELECT unnest(['country,time', 'geo,time']), 'shipped_qty', shipped_qty FROM shipments)
"""


@registered(PAIRS + """
SELECT kind, key, value, string_agg(resource, ',' ORDER BY place) AS resources
FROM pairs JOIN places USING (resource) GROUP BY kind, key, value
""")
def availability_build(spark, sf_dir):
    rows = build_availability(trade_dataset(spark, sf_dir))
    return rows.select("kind", canonical_key(F.col("key")).alias("key"), "value",
                       F.array_join("resources", ",").alias("resources"))


@registered(PAIRS + "SELECT DISTINCT key, value FROM pairs")
def schema_all(spark, sf_dir):
    """All schema views of a dataset whose index was found in the data."""
    dataset = trade_dataset(spark, sf_dir)
    indexed = dataset.with_index(build_availability(dataset))
    rows = query(indexed, "*.schema", ["key", "value"], order_by=["value"])
    return rows.select(canonical_key(F.col("key")).alias("key"), "value")


@registered(PAIRS + """
SELECT DISTINCT key, value FROM pairs WHERE kind = 'datapoints'
  AND (key LIKE '%,%,%' OR (key LIKE '%geo%' AND NOT value IN ('order_cents')))
""")
def schema_by_key_parts(spark, sf_dir):
    """Array operators on the key of the schema view."""
    dataset = trade_dataset(spark, sf_dir)
    indexed = dataset.with_index(build_availability(dataset))
    rows = query(
        indexed, "datapoints.schema", ["key", "value"],
        where={"$or": [
            {"key": {"$size": 3}},
            {"$and": [{"key": {"$all": ["geo"]}}, {"key": {"$elemMatch": {"$in": ["time"]}}},
                      {"value": {"$nin": ["order_cents"]}}]},
        ]},
    )
    return rows.select(canonical_key(F.col("key")).alias("key"), "value")


@registered(STATISTICS + """
SELECT key, value, min(cell) AS low, max(cell) AS high, round(avg(cell), 6) AS mean
FROM cells GROUP BY key, value
""")
def schema_stats(spark, sf_dir):
    dataset = trade_dataset(
        spark, sf_dir, "country_entities", "region_entities", "orders_by_country",
        "shipments_by_country", "orders_by_region", "corrections",
    )
    rows = query(dataset, "datapoints.schema", ["key", "value"],
                 ["min(value)", "max(value)", "avg(value)"])
    return rows.select(
        canonical_key(F.col("key")).alias("key"), "value", F.col("min(value)").alias("low"),
        F.col("max(value)").alias("high"), F.round("avg(value)", 6).alias("mean"),
    )


@registered(SQL + """
SELECT country, time, 'order_count' AS columns
FROM by_country o JOIN corrections c USING (country, time)
WHERE o.order_count <> c.order_count
""")
def merge_conflicts(spark, sf_dir):
    dataset = trade_dataset(
        spark, sf_dir, "country_entities", "orders_by_country", "shipments_by_country",
        "corrections",
    )
    return conflict_report(dataset, ["country", "time"], ["order_count", "shipped_qty"])


@registered(SQL + f"""
SELECT 'trade' AS dataset,
  (SELECT count(DISTINCT c_mktsegment) FROM customer) + {len(CONCEPTS) - len(SEGMENTS)} AS concepts,
  (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer)
    AS entities,
  (SELECT count(*) FROM by_country) + (SELECT count(*) FROM shipments)
    + (SELECT count(*) FROM by_region) + (SELECT count(*) FROM event_counts) + (SELECT count(*) FROM corrections)
    + (SELECT count(*) FROM by_segment) + (SELECT count(*) FROM by_customer) AS datapoints,
  (SELECT count(*) FROM nation) AS translations
""")
def dataset_size(spark, sf_dir):
    return dataset_sizes(trade_dataset(spark, sf_dir), [TRANSLATED])


@registered("""
SELECT lower(c_mktsegment) AS set_name, count(*) AS members FROM customer GROUP BY 1
""")
def members_per_set(spark, sf_dir):
    """Size of every set of a domain, from its membership columns."""
    entities = trade_dataset(spark, sf_dir, "customer_entities").resources["customer_entities"].frame
    flags = [c for c in entities.columns if c.startswith("is--")]
    counts = entities.agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in flags])
    return counts.unpivot([], flags, "flag", "members").select(
        set_name(F.col("flag")).alias("set_name"), "members"
    )


@registered("""
SELECT 'customers' AS resource, CAST(c_custkey AS VARCHAR) AS key, count(*) AS rows FROM customer
GROUP BY c_custkey HAVING count(*) > 1
UNION ALL SELECT 'buyers', concat_ws(',', o_custkey, o_orderpriority), count(*) FROM orders
GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1
UNION ALL SELECT 'sources', concat_ws(',', l_orderkey, l_suppkey), count(*) FROM lineitem
GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
""")
def repeated_unique_keys(spark, sf_dir):
    """Keys that resources declared unique repeat: none of customers, some of the others."""
    dataset = Dataset(spark, [
        Resource(name, key, table(spark, sf_dir, source), unique=True)
        for name, key, source in (("customers", ("c_custkey",), "customer"),
                                  ("buyers", ("o_custkey", "o_orderpriority"), "orders"),
                                  ("sources", ("l_orderkey", "l_suppkey"), "lineitem"))])
    return repeated_keys(dataset).withColumn("key", F.array_join("key", ","))


CHANGED_ORDERS = SQL + """,
facts AS (
  SELECT o_custkey AS customer, c_mktsegment AS segment, CAST(round(o_totalprice * 100) AS BIGINT)
           + CASE WHEN o_orderpriority = '1-URGENT' THEN 100000 ELSE 0 END AS cents,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS note
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
keyed AS (
  SELECT unnest(['customer,time', lower(segment) || ',time']) AS key, cents, note FROM facts)
"""


def _changed_state(spark, sf_dir) -> FactState:
    """Orders after two batches: late ones came and pending ones went, then urgent ones were repriced."""
    given = table(spark, sf_dir, "orders")
    late = F.crc32(F.col("o_orderkey").cast("string")) % 4 == 0
    pending, urgent = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"

    def facts(rows, more=0):
        note = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
        price = cents("o_totalprice") + F.when(urgent, more).otherwise(0)
        return rows.select(F.col("o_custkey").alias("customer"), year("o_orderdate"), price.alias("cents"), note.alias("note"))

    described = Resource("sold", ("customer", "time"), facts(given), columns=("cents", "note"))
    source = trade_dataset(spark, sf_dir, "customer_entities")
    concepts = concept_rows(spark, [*CONCEPTS, ("cents", "measure", None), ("note", "string", None)])
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts), source.resources["customer_entities"],
                              described], disjoint=True)
    state = FactState.build(dataset, described, facts(given.filter(~late)))
    kept = given.filter(~pending)
    state = state.change(facts(given.filter(late & ~pending)), facts(given.filter(~late & pending)),
                         of_ids(facts(kept), state.parts))
    return state.change(facts(kept.filter(urgent), 100000), facts(kept.filter(urgent)),
                        of_ids(facts(kept, 100000), state.parts))


@registered(CHANGED_ORDERS + """
SELECT key, 'cents' AS value, CAST(min(cents) AS DOUBLE) AS low, CAST(max(cents) AS DOUBLE) AS high,
       round(avg(cents), 4) AS mean FROM keyed GROUP BY key
""")
def statistics_after_changes(spark, sf_dir):
    """Statistics kept up to date; only customers that lost an extreme look at their orders again."""
    rows = _changed_state(spark, sf_dir).statistics()
    return rows.select(canonical_key(F.col("key")).alias("key"), "value", "low", "high", F.round("mean", 4).alias("mean"))


@registered(CHANGED_ORDERS + """
SELECT DISTINCT 'datapoints' AS kind, key, 'cents' AS value, 'sold' AS resources FROM keyed
UNION SELECT 'datapoints', key, 'note', 'sold' FROM keyed WHERE note IS NOT NULL
""")
def availability_after_changes(spark, sf_dir):
    rows = _changed_state(spark, sf_dir).availability()
    return rows.select("kind", canonical_key(F.col("key")).alias("key"), "value",
                       F.array_join("resources", ",").alias("resources"))


@registered(SQL + """,
cells AS (
  SELECT unnest(['customer,time', lower(segment) || ',time']) AS key, c.order_cents AS cell
  FROM by_customer c JOIN (SELECT c_custkey AS customer, c_mktsegment AS segment FROM customer) USING (customer))
SELECT key, 'order_cents' AS value, count(*) AS n, CAST(min(cell) AS DOUBLE) AS low, CAST(max(cell) AS DOUBLE) AS high,
       true AS median_is_near
FROM cells GROUP BY key
""")
def sketched_quantiles(spark, sf_dir):
    """Medians from the stored sketches of two files, near the exact ones of the facts."""
    source = trade_dataset(spark, sf_dir, "customer_entities", "customer_orders")
    described = source.resources["customer_orders"]
    sold = Resource("sold", described.key, described.frame.select("customer", "time", "order_cents"), unique=True)
    dataset = Dataset(spark, [source.resources["concepts"], source.resources["customer_entities"], sold], disjoint=True)
    folder, even = shared_folder(spark, "sketches"), F.crc32(F.col("customer").cast("string")) % 2 == 0
    for name, part in (("first", sold.frame.filter(even)), ("second", sold.frame.filter(~even))):
        value_sketches(dataset, sold, part).write.parquet(f"{folder}/{name}")
    stored = [spark.read.parquet(f"{folder}/{name}") for name in ("first", "second")]
    rows = quantiles(dataset, sold, stored, [0, 0.5, 1]).select(
        canonical_key(F.col("key")).alias("key"), "value", "n", F.col("quantiles")[0].alias("low"),
        F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("high"))
    entities = source.resources["customer_entities"].frame
    names = F.array(F.lit("customer,time"), *[F.when(F.col(f"`is--{s.lower()}`"), F.lit(f"{s.lower()},time")) for s in SEGMENTS])
    near = sold.frame.join(entities, "customer").select(F.explode(F.array_compact(names)).alias("key"), "order_cents")
    near = near.groupBy("key").agg(F.percentile("order_cents", 0.47).alias("below"), F.percentile("order_cents", 0.53).alias("above"))
    return rows.join(near, "key").select(
        "key", "value", "n", "low", "high", F.col("median").between(F.col("below"), F.col("above")).alias("median_is_near"))
