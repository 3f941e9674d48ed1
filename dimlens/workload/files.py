"""Folder sources and result files: derived tables are stored, then read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dimlens.functions.keys import canonical_key
from dimlens.model import Dataset, Resource
from dimlens.plans.query import query
from dimlens.plans.reader import Reader
from dimlens.session import shared_folder
from dimlens.sources.assets import ASSET_FOLDER, get_asset
from dimlens.sources.manifest import INDEX_MEMBER, manifest_index, open_folder, parse_manifests
from dimlens.sources.sinks import csv_lines, json_lines, tabular, write_clustered, write_folder
from dimlens.workload.datapoints import BOTH
from dimlens.workload.registry import registered
from dimlens.workload.trade import (
    CONCEPTS,
    SQL,
    TRANSLATED,
    concept_rows,
    customer_orders,
    orders_by_segment,
    spending,
    table,
    trade_dataset,
)


def _folder(spark, sf_dir, *names):
    folder = shared_folder(spark, "folder")
    write_folder(trade_dataset(spark, sf_dir, *names), folder, languages=[TRANSLATED])
    return folder


@registered(SQL + """
SELECT country, time, CAST(order_count AS DOUBLE) AS order_count,
       CAST(shipped_qty AS DOUBLE) AS shipped_qty
FROM merged WHERE time >= '1996' AND (order_count IS NULL OR shipped_qty > 10000)
""")
def dp_folder_source(spark, sf_dir):
    """A datapoint query on delimited files below a manifest."""
    dataset = open_folder(spark, _folder(spark, sf_dir, *BOTH))
    return query(
        dataset, "datapoints", ["country", "time"], ["order_count", "shipped_qty"],
        where={"time": {"$gte": "1996"},
               "$or": [{"order_count": None}, {"shipped_qty": {"$gt": 10000}}]},
    )


@registered("""
SELECT n_name AS geo, CASE WHEN length(n_name) > 8 THEN 'nl-' || n_name
       ELSE upper(n_name[1]) || lower(n_name[2:]) END AS name, true AS "is--country" FROM nation
""")
def ent_folder_translated(spark, sf_dir):
    """Translated entities from files, asked for by their domain."""
    dataset = open_folder(spark, _folder(spark, sf_dir, "country_entities", "region_entities"))
    return query(dataset, "entities", ["geo"], ["name", "is--country"],
                 where={"is--country": True}, language=TRANSLATED)


@registered(SQL + """,
leaders AS (
  SELECT country, time, arg_max(segment, (order_count, order_cents, segment)) AS top_segment
  FROM by_segment GROUP BY ALL)
SELECT country, time, CASE WHEN time >= '1998' AND top_segment <> 'BUILDING'
       THEN lower(top_segment) ELSE top_segment END AS top_segment,
       CAST(shipped_qty AS DOUBLE) AS shipped_qty
FROM leaders FULL JOIN shipments USING (country, time) WHERE time >= '1994'
""")
def dp_folder_translated(spark, sf_dir):
    """Translated datapoints spread over files by country, one scan for all and one for their
    translations."""
    place = F.struct("order_count", "order_cents", "segment")
    leading = orders_by_segment(spark, sf_dir, {}).groupBy("country", "time").agg(
        F.max_by("segment", place).alias("top_segment"))
    later = leading.filter("time >= '1998'").withColumn("top_segment", F.when(
        F.col("top_segment") == "BUILDING", "").otherwise(F.lower("top_segment")))
    shelf = F.crc32("country") % 4
    source = trade_dataset(spark, sf_dir, "country_entities", "shipments_by_country")
    shelves = [Resource(f"leading_{i}", ("country", "time"), leading.filter(shelf == i),
                        {TRANSLATED: later.filter(shelf == i)}) for i in range(4)]
    folder = shared_folder(spark, "folder")
    write_folder(Dataset(spark, [*source.resources.values(), *shelves], disjoint=True), folder, languages=[TRANSLATED])
    return query(open_folder(spark, folder), "datapoints", ["country", "time"], ["top_segment", "shipped_qty"],
                 where={"time": {"$gte": "1994"}}, language=TRANSLATED)


def _tables_manifest() -> str:
    """A manifest whose resources are the given tables."""
    def concepts(kind, *names):
        return [{"concept": name, "concept_type": kind} for name in names]

    def table_of(name, key, *values):
        fields = [{"name": n} for n in (*key, *values)]
        return {"name": name, "path": f"{name}.parquet", "format": "parquet",
                "schema": {"primaryKey": list(key), "fields": fields}}

    def pairs(name, key, *values):
        return [{"primaryKey": list(key), "value": v, "resources": [name]} for v in values]

    customer = ("customer", ("c_custkey",), "c_name", "c_acctbal")
    lineitem = ("lineitem", ("l_orderkey", "l_linenumber"), "l_quantity", "l_returnflag")
    return json.dumps({
        "resources": [
            {"name": "concepts", "schema": {"primaryKey": "concept"}, "data": [
                *concepts("entity_domain", "c_custkey", "l_orderkey", "l_linenumber"),
                *concepts("string", "c_name", "l_returnflag"),
                *concepts("measure", "c_acctbal", "l_quantity")]},
            table_of(*customer), table_of(*lineitem),
        ],
        "translations": [],
        INDEX_MEMBER: {
            "concepts": pairs("concepts", ("concept",), "concept_type"),
            "entities": pairs(*customer), "datapoints": pairs(*lineitem),
        },
    })


@registered("""
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000
""")
def reader_entities(spark, sf_dir):
    """A request to a reader whose dataset is the given tables."""
    reader = Reader(spark, sf_dir, manifest=_tables_manifest(), unique_keys=True)
    return reader.read({
        "from": "entities", "select": {"key": ["c_custkey"], "value": ["c_name", "c_acctbal"]},
        "where": {"c_acctbal": {"$gt": 5000}},
    })


@registered("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 30 AND l_returnflag = 'R'
""")
def reader_datapoints(spark, sf_dir):
    reader = Reader(spark, sf_dir, manifest=_tables_manifest(), unique_keys=True)
    return reader.read({
        "from": "datapoints",
        "select": {"key": ["l_orderkey", "l_linenumber"], "value": ["l_quantity"]},
        "where": {"l_quantity": {"$gt": 30}, "l_returnflag": "R"},
    })


@registered("""
SELECT DISTINCT 'datapoints' AS kind, n_name || ',time' AS key, lower(c_mktsegment) AS value,
       'orders' AS resources
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'entities', n_name, 'segment', 'nations,' || n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def manifest_pairs(spark, sf_dir):
    """The availability index of one manifest per nation, with a value for each segment it has."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    found = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_name", F.lower("c_mktsegment").alias("segment")).agg(F.count("*").alias("rows"))
    entry = F.struct(F.array("n_name", F.lit("time")).alias("primaryKey"),
                     F.col("segment").alias("value"), F.array(F.lit("orders")).alias("resources"))
    entities = F.array(F.struct(F.col("n_name").alias("primaryKey"), F.lit("segment").alias("value"),
                                F.array(F.lit("nations"), F.col("n_name")).alias("resources")))
    texts = found.groupBy("n_name").agg(F.collect_list(entry).alias("datapoints")).select(
        F.to_json(F.struct(F.struct(
            F.array().cast("array<string>").alias("concepts"), entities.alias("entities"),
            "datapoints").alias(INDEX_MEMBER))))
    index = manifest_index(parse_manifests(texts))
    return index.select("kind", canonical_key(F.col("key")).alias("key"), "value",
                        F.array_join("resources", ",").alias("resources"))


@registered(SQL + """
SELECT customer, time, order_cents, CAST(NULL AS VARCHAR) AS note FROM by_customer
""")
def result_as_json(spark, sf_dir):
    """Every row as the line of text that a JSON result holds, and back."""
    rows = tabular(customer_orders(spark, sf_dir, {}), ["customer", "time"], ["order_cents", "note"])
    line = json_lines(rows)
    return line.select(F.from_json("value", rows.schema).alias("row")).select("row.*")


@registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority,
       o_orderstatus || ', "' || o_orderpriority || '"' AS label FROM orders
""")
def result_as_csv(spark, sf_dir):
    """Every row as a line of a delimited result, and back: delimiters and quotes survive."""
    label = F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"'))
    rows = table(spark, sf_dir, "orders").withColumn("label", label)
    line = csv_lines(tabular(rows, ["o_orderkey"], ["o_orderpriority", "label"]))
    schema = "o_orderkey string, o_orderpriority string, label string"
    return line.select(F.from_csv("value", schema, {"escape": '"'}).alias("row")).select("row.*")


@registered("""
SELECT n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def asset_rows(spark, sf_dir):
    """A JSON asset per region, read back as rows. A region's asset lists its nations, so its size
    is that of one document."""
    folder = shared_folder(spark, "dataset")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region")
    )
    documents = rows.groupBy("region").agg(
        F.to_json(F.collect_list(F.struct("country", "region"))).alias("value")
    )
    documents.write.partitionBy("region").text(f"{folder}/{ASSET_FOLDER}/regions.json")
    return get_asset(spark, folder, f"{ASSET_FOLDER}/regions.json").select("country", "region")


@registered(SQL + """
SELECT country, segment, priority, time, CAST(spent_cents AS DOUBLE) AS spent_cents FROM spending
WHERE segment = 'BUILDING' AND time >= '1996'
""")
def dp_clustered_files(spark, sf_dir):
    """Four dimensions laid out along a curve; a condition on two of them skips most files."""
    folder, key = shared_folder(spark, "clustered"), ("country", "segment", "priority", "time")
    write_clustered(spending(spark, sf_dir, {}), folder, key, rows_per_file=500)
    concepts = concept_rows(spark, [*CONCEPTS, ("priority", "entity_domain", None), ("spent_cents", "measure", None)])
    countries = trade_dataset(spark, sf_dir, "country_entities").resources["country_entities"]
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts), countries,
                              Resource("spending", key, spark.read.parquet(folder), unique=True)])
    rows = query(dataset, "datapoints", list(key), ["spent_cents"],
                 where={"segment": "BUILDING", "time": {"$gte": "1996"}})
    return rows.withColumn("spent_cents", F.col("spent_cents").cast("double"))
