"""Datapoint queries on the trade dataset."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dimlens.model import Dataset, Resource
from dimlens.operators.order import guard_rows, page_rows
from dimlens.plans.query import query, read
from dimlens.workload.registry import registered
from dimlens.workload.trade import (
    CONCEPTS,
    SQL,
    TRANSLATED,
    concept_rows,
    orders_by_segment,
    spending,
    table,
    trade_dataset,
)

COUNTS = ("orders_by_country", "corrections", "country_entities")
BOTH = (*COUNTS, "shipments_by_country")
EVENTFUL = (*COUNTS, "events_by_country")


@registered(SQL + "SELECT * FROM counted WHERE CAST(time AS INT) > 1996 AND time < '2000'")
def dp_plain_range(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *COUNTS), "datapoints", ["country", "time"],
        ["order_count"], where={"time": {"$gt": 1996, "$lt": "2000"}},
        order_by=["time", "country"],
    )


@registered(SQL + "SELECT * FROM eventful")
def dp_two_indicators_merge(spark, sf_dir):
    """Indicators of different years: either leaves gaps."""
    return query(
        trade_dataset(spark, sf_dir, *EVENTFUL), "datapoints", ["country", "time"],
        ["order_count", "event_count"],
    )


@registered(SQL + "SELECT * FROM counted WHERE order_count < 50 OR order_count >= 80")
def dp_last_file_wins(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *COUNTS), "datapoints", ["country", "time"],
        ["order_count"],
        where={"$or": [{"order_count": {"$lt": 50}}, {"order_count": {"$gte": 80}}]},
    )


@registered(SQL + """
SELECT * FROM merged WHERE country IN (SELECT country FROM countries WHERE world_region = 'ASIA')
""")
def dp_semi_join_property(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"], where={"$and": [{"country": "$country"}]},
        join={"$country": {"key": "country", "where": {"world_region": "ASIA"}}},
        order_by=["country", "time"],
    )


@registered(SQL + """
SELECT * FROM merged
WHERE country IN (SELECT country FROM countries WHERE world_region = 'EUROPE')
   OR coalesce(shipped_qty > 20000, false)
""")
def dp_semi_join_or(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"],
        where={"$or": [{"country": "$country"}, {"shipped_qty": {"$gt": 20000}}]},
        join={"$country": {"key": "country", "where": {"world_region": "EUROPE"}}},
    )


@registered(SQL + """
SELECT * FROM merged WHERE time BETWEEN '1996' AND '1999' AND time NOT IN ('1998')
""")
def dp_time_join(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"], where={"$and": [{"time": "$time"}]},
        join={"$time": {"key": "time", "where": {
            "$and": [{"time": {"$gte": "1996", "$lte": "1999"}}, {"time": {"$nin": ["1998"]}}]}}},
    )


GEO_SQL = SQL + """,
geo_counts AS (
  SELECT geo, time, arg_max(order_count, place) AS order_count FROM (
    SELECT country AS geo, time, order_count, 1 AS place FROM by_country
    UNION ALL SELECT world_region, time, order_count, 2 FROM by_region
    UNION ALL SELECT country, time, order_count, 3 FROM corrections) GROUP BY ALL)
"""


@registered(GEO_SQL + """
SELECT geo AS world_region, time, order_count FROM geo_counts
WHERE geo IN (SELECT r_name FROM region)
""")
def dp_set_key_from_domain(spark, sf_dir):
    """A file keyed by the domain answers for a set of it."""
    source = trade_dataset(spark, sf_dir)
    stored = query(source, "datapoints", ["geo", "time"], ["order_count"])
    entities = [source.resources[n] for n in ("concepts", "country_entities", "region_entities")]
    dataset = Dataset(spark, [*entities, Resource("counts", ("geo", "time"), stored)])
    return query(dataset, "datapoints", ["world_region", "time"], ["order_count"])


@registered(GEO_SQL + "SELECT * FROM geo_counts")
def dp_domain_key_from_sets(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *COUNTS, "orders_by_region"), "datapoints",
        ["geo", "time"], ["order_count"],
    )


@registered(SQL + """
SELECT * FROM eventful
WHERE event_count IS DISTINCT FROM 70 AND coalesce(order_count NOT IN (60, 70, 80), true)
  AND country <> 'NATION_7'
""")
def dp_ne_nin_nulls(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *EVENTFUL), "datapoints", ["country", "time"],
        ["order_count", "event_count"],
        where={"event_count": {"$ne": 70}, "order_count": {"$nin": [60, 70, 80]},
               "country": {"$ne": "NATION_7"}},
    )


@registered(SQL + """
SELECT * FROM eventful
WHERE NOT coalesce(order_count > 80, false)
  AND NOT (coalesce(event_count < 50, false) OR time = '1999')
""")
def dp_not_nor(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *EVENTFUL), "datapoints", ["country", "time"],
        ["order_count", "event_count"],
        where={"order_count": {"$not": {"$gt": 80}},
               "$nor": [{"event_count": {"$lt": 50}}, {"time": "1999"}]},
    )


@registered(SQL + """
SELECT * FROM merged
WHERE ((order_count BETWEEN 20 AND 90 AND shipped_qty IS NOT NULL) OR time IN ('1995', '1996'))
  AND country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_12', 'NATION_17')
""")
def dp_nested_and_or(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"],
        where={"$and": [
            {"$or": [
                {"$and": [{"order_count": {"$gte": 20, "$lte": 90}},
                          {"shipped_qty": {"$ne": None}}]},
                {"time": {"$in": ["1995", "1996"]}},
            ]},
            {"country": {"$in": ["NATION_1", "NATION_2", "NATION_3", "NATION_12", "NATION_17"]}},
        ]},
    )


@registered(SQL + "SELECT country, time, shipped_qty, CAST(NULL AS DOUBLE) AS backlog FROM shipments "
            "WHERE time = '1999'")
def dp_missing_value_column(spark, sf_dir):
    """A value that no file holds is an empty column when names are not checked."""
    return query(
        trade_dataset(spark, sf_dir, "shipments_by_country", "country_entities"), "datapoints",
        ["country", "time"], ["shipped_qty", "backlog"], where={"time": {"$eq": 1999}},
        strict=False,
    ).withColumn("backlog", F.col("backlog").cast("double"))


@registered(SQL + """
SELECT m.country, time, order_count, shipped_qty
FROM merged m JOIN countries c ON m.country = c.country
WHERE c.world_region IN ('AFRICA', 'ASIA') AND time <> '2001' AND shipped_qty >= 1000
""")
def dp_combined_joins(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"],
        where={"$and": [{"country": "$country"}, {"time": "$time"},
                        {"shipped_qty": {"$gte": 1000}}]},
        join={
            "$country": {"key": "country", "where": {"$and": [
                {"is--country": True}, {"world_region": {"$in": ["AFRICA", "ASIA"]}}]}},
            "$time": {"key": "time", "where": {"time": {"$ne": "2001"}}},
        },
        order_by=["time", {"shipped_qty": "desc"}],
    )


@registered(SQL + """
SELECT country, segment, time, order_count, order_cents FROM by_segment
WHERE segment <> 'BUILDING' AND time >= '1998'
  AND country IN (SELECT country FROM countries WHERE world_region = 'AMERICA')
""")
def dp_three_dimensions(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "orders_by_segment", "country_entities"), "datapoints",
        ["country", "segment", "time"], ["order_count", "order_cents"],
        where={"country": "$country", "segment": {"$ne": "BUILDING"}, "time": {"$gte": "1998"}},
        join={"$country": {"key": "country", "where": {"world_region": "AMERICA"}}},
    )


@registered(SQL + """
SELECT country, time, segment, priority, spent_cents FROM spending
WHERE country IN (SELECT country FROM countries WHERE world_region IN ('EUROPE', 'AFRICA'))
  AND time = '1999' AND priority <> '5-LOW' AND segment IN ('BUILDING', 'MACHINERY')
""")
def dp_four_dimensions(spark, sf_dir):
    """Every dimension constrained, two of them through joins."""
    concepts = [*CONCEPTS, ("priority", "entity_domain", None), ("spent_cents", "measure", None)]
    source = functools.partial(spending, spark, sf_dir)
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), concept_rows(spark, concepts)),
        trade_dataset(spark, sf_dir).resources["country_entities"],
        Resource("spending", ("country", "segment", "priority", "time"),
                 functools.partial(source, {}), columns=("spent_cents",), bounded=source),
    ], disjoint=True)
    return query(
        dataset, "datapoints", ["country", "time", "segment", "priority"], ["spent_cents"],
        where={"$and": [{"country": "$country"}, {"time": "$time"},
                        {"priority": {"$nin": ["5-LOW"]}},
                        {"segment": {"$in": ["BUILDING", "MACHINERY"]}}]},
        join={
            "$country": {"key": "country", "where": {"$and": [
                {"$or": [{"world_region": "EUROPE"}, {"world_region": "AFRICA"}]},
                {"is--country": True}]}},
            "$time": {"key": "time", "where": {"time": "1999"}},
        },
        order_by=["country", "time", "segment", "priority"],
    )


@registered(SQL + """
SELECT customer, time, order_count, order_cents FROM by_customer
WHERE time >= '1997' AND customer IN (
  SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment = 'BUILDING' AND n_name IN ('NATION_1', 'NATION_5', 'NATION_9')
    AND c_acctbal > 0)
""")
def dp_large_domain_semi_join(spark, sf_dir):
    """The constrained dimension is as large as the customer table."""
    return query(
        trade_dataset(spark, sf_dir, "customer_orders", "customer_entities"), "datapoints",
        ["customer", "time"], ["order_count", "order_cents"],
        where={"$and": [{"customer": "$customer"}, {"time": "$time"}]},
        join={
            "$customer": {"key": "customer", "where": {
                "is--building": True, "balance": {"$gt": 0},
                "home": {"$in": ["NATION_1", "NATION_5", "NATION_9"]}}},
            "$time": {"key": "time", "where": {"time": {"$gte": "1997"}}},
        },
    )


@registered(SQL + """
SELECT customer AS machinery, time, order_cents FROM by_customer
WHERE customer IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
""")
def dp_large_set_key(spark, sf_dir):
    """Rows of a domain limited to the members of one of its sets."""
    return query(
        trade_dataset(spark, sf_dir, "customer_orders", "customer_entities"), "datapoints",
        ["machinery", "time"], ["order_cents"],
    )


@registered(SQL + """
SELECT * FROM merged ORDER BY shipped_qty DESC NULLS LAST, country, time LIMIT 40
""")
def dp_sorted_top(spark, sf_dir):
    """Several sort keys, all direction forms, and the row guard as a top-k."""
    rows = query(
        trade_dataset(spark, sf_dir, *BOTH), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"],
        order_by=[{"shipped_qty": -1}, "country", {"time": 1}],
    )
    return guard_rows(rows, 40)


PAGED_BY = [{"o_totalprice": -1}, "o_orderpriority"]


@registered("""
SELECT *, CAST((row_number() OVER (
  ORDER BY o_totalprice DESC NULLS LAST, o_orderpriority NULLS FIRST, o_orderkey) - 1) // 300 AS INT) AS page
FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS o_totalprice, o_orderpriority, o_orderkey FROM orders)
QUALIFY page < 3
""")
def dp_pages(spark, sf_dir):
    """Three pages of orders by price, each found from the last row of the one before."""
    price = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(price, "o_orderpriority", "o_orderkey")
    pages, after = [], None
    for number in range(3):
        page = page_rows(rows, PAGED_BY, 300, ["o_orderkey"], after).collect()
        pages += [(*row, number) for row in page]
        after = page[-1].asDict() if page else None
    return spark.createDataFrame(pages, rows.schema.add("page", "integer"))


@registered("""
WITH cells AS (
  SELECT user_id AS customer, strftime(ts, '%Y-%m-%d') AS time, event_type, value, ts, event_id
  FROM events),
clicks AS (
  SELECT customer, time, arg_max(value, (ts, event_id)) AS balance FROM cells
  WHERE event_type = 'click' GROUP BY ALL),
others AS (
  SELECT customer, time, arg_max(value, (ts, event_id)) AS balance FROM cells
  WHERE event_type <> 'click' GROUP BY ALL)
SELECT customer, time, coalesce(o.balance, c.balance) AS balance
FROM clicks c FULL JOIN others o USING (customer, time)
""")
def dp_repeated_keys_last_row(spark, sf_dir):
    """Files that repeat their keys: the last row by its time stamp counts, then the last file."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer"), F.date_format("ts", "yyyy-MM-dd").alias("time"),
        F.col("value").alias("balance"), "event_type", "ts", "event_id",
    )
    source = trade_dataset(spark, sf_dir, "customer_entities")
    order, key = F.struct("ts", "event_id"), ("customer", "time")
    dataset = Dataset(spark, [*source.resources.values(), *(
        Resource(name, key, events.filter(kind), columns=("balance",), row_order=order)
        for name, kind in (("clicks", "event_type = 'click'"), ("others", "event_type <> 'click'"))
    )], disjoint=True)
    return query(dataset, "datapoints", ["customer", "time"], ["balance"])


@registered(SQL + """
SELECT lower(country) AS country, time, order_count * 2 AS order_count,
       order_count > 60 AS busy FROM counted
""")
def dp_custom_parsers(spark, sf_dir):
    request = {
        "from": "datapoints",
        "select": {"key": ["country", "time"], "value": ["order_count"]},
        "animatable": "time",
    }
    return read(
        trade_dataset(spark, sf_dir, *COUNTS), request,
        parsers={"country": F.lower, "order_count": lambda cell: cell * 2},
        transformer=lambda rows: rows.withColumn("busy", F.col("order_count") > 120),
    )


@registered(SQL + """,
leaders AS (
  SELECT country, time, arg_max(segment, (order_count, order_cents, segment)) AS top_segment
  FROM by_segment GROUP BY ALL)
SELECT country, time, CASE WHEN time >= '1998' AND top_segment <> 'BUILDING'
       THEN lower(top_segment) ELSE top_segment END AS top_segment
FROM leaders WHERE time <> '1995'
UNION ALL SELECT country, time, lower(top_segment) FROM leaders
WHERE time = '1995' AND top_segment <> 'BUILDING'
""")
def dp_translated(spark, sf_dir):
    """Text datapoints with later and partly empty translations, some of rows not in the base."""
    place = F.struct("order_count", "order_cents", "segment")
    leading = orders_by_segment(spark, sf_dir, {}).groupBy("country", "time").agg(
        F.max_by("segment", place).alias("top_segment")
    )
    segment = F.col("top_segment")
    translated = leading.filter("time >= '1998' OR time = '1995' AND top_segment <> 'BUILDING'")
    translated = translated.withColumn(
        "top_segment", F.when(segment == "BUILDING", "").otherwise(F.lower(segment))
    )
    base = leading.filter("time <> '1995'")
    source = trade_dataset(spark, sf_dir, "country_entities")
    dataset = Dataset(spark, [
        *source.resources.values(),
        Resource("leading", ("country", "time"), base, {TRANSLATED: translated}, unique=True),
    ], disjoint=True)
    return query(dataset, "datapoints", ["country", "time"], ["top_segment"], language=TRANSLATED)
