"""Entity and concept queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.functions.cells import is_identifier
from dimlens.functions.concepts import concept_class
from dimlens.functions.keys import membership_column, sets_of_row
from dimlens.model import Dataset, Resource
from dimlens.operators.documents import translate_properties
from dimlens.operators.merge import conflicts
from dimlens.operators.reports import unknown_names
from dimlens.plans.query import members, query
from dimlens.workload.registry import registered
from dimlens.workload.trade import (
    TRANSLATED,
    concept_rows,
    countries,
    country_entities,
    country_translations,
    table,
    trade_dataset,
)


@registered("""
SELECT c_custkey AS customer, c_name AS name, n_name AS home, c_mktsegment = 'FURNITURE'
       AS "is--furniture"
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal >= 1000
""")
def ent_by_set_flag(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "customer_entities"), "entities", ["customer"],
        ["name", "home", "is--furniture"],
        where={"is--furniture": False, "balance": {"$gte": 1000}},
    )


@registered("SELECT n_name AS geo FROM nation UNION SELECT r_name FROM region")
def ent_key_only(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "country_entities", "region_entities"), "entities", ["geo"]
    )


@registered("""
SELECT n_name AS country, r_name AS world_region,
       CASE WHEN length(n_name) > 8 THEN 'nl-' || n_name
            ELSE upper(n_name[1]) || lower(n_name[2:]) END AS name
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def ent_translated(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "country_entities"), "entities", ["country"],
        ["name", "world_region"], language=TRANSLATED,
    )


@registered("""
SELECT c_custkey AS building, c_name AS name, c_acctbal AS balance FROM customer
WHERE c_mktsegment = 'BUILDING' AND (c_acctbal < 0 OR c_name > 'Customer#000001')
""")
def ent_set_key(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "customer_entities"), "entities", ["building"],
        ["name", "balance"],
        where={"$or": [{"balance": {"$lt": 0}}, {"name": {"$gt": "Customer#000001"}}]},
        order_by=[{"balance": "desc"}, "name"],
    )


@registered("""
SELECT c_custkey AS customer, c_name AS name, c_acctbal AS balance FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
                      WHERE r_name = 'AFRICA')
   OR c_mktsegment = 'HOUSEHOLD'
""")
def ent_join_through_property(spark, sf_dir):
    """A join inside ``$or`` whose target has the constrained column under another name."""
    customers = trade_dataset(spark, sf_dir, "customer_entities").resources["customer_entities"]
    places = country_entities(spark, sf_dir)
    concepts = concept_rows(spark, [
        ("customer", "entity_domain", None), ("household", "entity_set", "customer"),
        ("home", "entity_domain", None), ("name", "string", None), ("balance", "measure", None),
        ("world_region", "string", None),
    ])
    homes = places.select(F.col("country").alias("home"), "world_region")
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), concepts),
        Resource("customers", ("customer",), customers.frame.select(
            "customer", "name", "home", "balance", "is--household")),
        Resource("homes", ("home",), homes),
    ])
    return query(
        dataset, "entities", ["customer"], ["name", "balance"],
        where={"$or": [{"home": "$home"}, {"is--household": True}]},
        join={"$home": {"key": "home", "where": {"world_region": "AFRICA"}}},
    )


@registered("SELECT c_custkey AS customer FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def set_members(spark, sf_dir):
    return members(trade_dataset(spark, sf_dir, "customer_entities"), "automobile")


@registered("""
SELECT c_custkey AS customer, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
  THEN lower(c_mktsegment) ELSE 'customer' END
  AS sets FROM customer
""")
def sets_per_entity(spark, sf_dir):
    """Sets an entity belongs to; the name of its key where no flag is set."""
    customers = trade_dataset(spark, sf_dir, "customer_entities").resources["customer_entities"]
    flags = {s: F.col(membership_column(s)) for s in ("building", "machinery")}
    sets = sets_of_row(flags, F.lit("customer"))
    return customers.frame.select("customer", F.array_join(sets, ",").alias("sets"))


@registered("""
SELECT concept, concept_type, domain FROM (
  SELECT DISTINCT lower(c_mktsegment) AS concept, 'entity_set' AS concept_type,
         'customer' AS domain FROM customer
  UNION ALL SELECT DISTINCT event_type, 'measure', NULL FROM events)
""")
def concepts_by_type(spark, sf_dir):
    return query(
        _derived_concepts(spark, sf_dir), "concepts", ["concept"], ["concept_type", "domain"],
        where={"concept_type": {"$in": ["entity_set", "measure"]}}, order_by=["concept"],
    )


@registered("""
SELECT class, count(*) AS concepts FROM (
  SELECT DISTINCT lower(c_mktsegment) AS concept, 'discrete' AS class FROM customer
  UNION ALL SELECT DISTINCT event_type, 'continuous' FROM events
  UNION ALL SELECT DISTINCT lower(p_type), 'discrete' FROM part
  UNION ALL VALUES ('customer', 'discrete'), ('name', 'discrete')) GROUP BY class
""")
def concept_classes(spark, sf_dir):
    rows = query(_derived_concepts(spark, sf_dir), "concepts", ["concept"], ["concept_type"])
    classes = rows.groupBy(concept_class(F.col("concept_type")).alias("class"))
    return classes.agg(F.count("*").alias("concepts"))


@registered("""
SELECT event_type AS concept, CAST(count(*) AS DOUBLE) AS rank, sum(value) > 100 AS common
FROM events GROUP BY event_type
""")
def concepts_retyped(spark, sf_dir):
    """Columns of the concept table take the types of their own concepts."""
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("concept")).agg(
        F.lit("measure").alias("concept_type"),
        F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("rank"),
        F.when(F.sum("value") > 100, "TRUE").otherwise("false").alias("common"),
    )
    own = concept_rows(spark, [("rank", "measure", None), ("common", "boolean", None)])
    dataset = Dataset(spark, [
        Resource("own_concepts", ("concept",), own),
        Resource("event_concepts", ("concept",), events),
    ])
    return query(dataset, "concepts", ["concept"], ["rank", "common"],
                 where={"concept": {"$nin": ["rank", "common"]}})


def _derived_concepts(spark, sf_dir) -> Dataset:
    """Two concept files found in the tables: segments and part types, then event types."""
    segment, kind, event = F.lower("c_mktsegment"), F.lower("p_type"), F.col("event_type")
    entities = (
        table(spark, sf_dir, "customer")
        .select(segment.alias("concept"), F.lit("entity_set").alias("concept_type"),
                F.lit("customer").alias("domain"))
        .union(table(spark, sf_dir, "part").select(kind, F.lit("string"), F.lit("")))
        .distinct()
        .union(concept_rows(spark, [("customer", "entity_domain", None), ("name", "string", None)]))
    )
    measures = table(spark, sf_dir, "events").select(
        event.alias("concept"), F.lit("measure").alias("concept_type")
    ).distinct()
    return Dataset(spark, [
        Resource("entity_concepts", ("concept",), entities),
        Resource("measure_concepts", ("concept",), measures),
    ])


@registered("""
SELECT event_type AS name, count(*) AS rows FROM events
WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type
""")
def unknown_columns(spark, sf_dir):
    """Indicators in the event stream that the concept table lacks."""
    concepts = concept_rows(spark, [(n, "measure", None) for n in ("click", "view", "purchase")])
    return unknown_names(table(spark, sf_dir, "events"), "event_type", concepts)


@registered("""
SELECT c_mktsegment AS segment, count(*) AS ids,
       CAST(count(*) FILTER (WHERE NOT regexp_full_match(c_name, '[a-z0-9_]*')) AS BIGINT)
         AS bad_names,
       CAST(count(*) FILTER (WHERE NOT regexp_full_match(lower(c_mktsegment), '[a-z0-9_]*'))
         AS BIGINT) AS bad_segments
FROM customer GROUP BY c_mktsegment
""")
def id_format(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("ids"),
        F.count_if(~is_identifier(F.col("c_name"))).alias("bad_names"),
        F.count_if(~is_identifier(F.lower("c_mktsegment"))).alias("bad_segments"),
    )


@registered("""
SELECT p_partkey, CASE WHEN p_size < 25 THEN lower(p_name) WHEN p_size < 40 THEN ''
                       ELSE p_name END AS name, p_brand AS brand
FROM part
""")
def document_translation(spark, sf_dir):
    """Properties and their translations in one row; an empty translation replaces too."""
    part = table(spark, sf_dir, "part")
    properties = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    overlay = F.when(F.col("p_size") < 25, F.create_map(F.lit("name"), F.lower("p_name"))).when(
        F.col("p_size") < 40, F.create_map(F.lit("name"), F.lit(""))
    )
    languages = F.create_map(F.lit("nl"), overlay)
    translated = translate_properties(properties, languages, "nl")
    return part.select("p_partkey", translated.alias("t")).select(
        "p_partkey", F.col("t.name").alias("name"), F.col("t.brand").alias("brand")
    )


@registered("""
SELECT n_name AS country, 'name' AS columns FROM nation
WHERE n_nationkey % 3 <> 0
""")
def translation_conflicts(spark, sf_dir):
    """Where a translated name, or its absence, differs from the original; a third is untranslated."""
    names = countries(spark, sf_dir).select(
        "n_nationkey", "country", F.initcap("country").alias("name"))
    translated = country_translations(spark, sf_dir).withColumnRenamed("name", "translated")
    translated = names.join(translated, "country").select(
        "country", F.when(F.col("n_nationkey") % 3 == 0, F.col("name"))
        .otherwise(F.col("translated")).alias("name"))
    return conflicts([names.drop("n_nationkey"), translated], ["country"])


@registered("""
SELECT c_custkey AS customer, c_name AS name FROM customer
WHERE (c_custkey % 2 = 0 AND c_custkey < 6000) OR c_name IN ('Customer#1', 'Customer#000000001')
""")
def ent_long_in_list(spark, sf_dir):
    """A list of three thousand ids, inside a disjunction."""
    return query(
        trade_dataset(spark, sf_dir, "customer_entities"), "entities", ["customer"], ["name"],
        where={"$or": [{"customer": {"$in": list(range(0, 6000, 2))}},
                       {"name": {"$in": ["Customer#1", "Customer#000000001"]}}]},
    )


@registered("""
SELECT c_custkey AS customer, c_acctbal AS balance FROM customer
WHERE NOT (c_custkey % 3 = 0 AND c_custkey < 9000) AND c_acctbal > 0
""")
def ent_nin_long_list(spark, sf_dir):
    return query(
        trade_dataset(spark, sf_dir, "customer_entities"), "entities", ["customer"], ["balance"],
        where={"customer": {"$nin": [str(i) for i in range(0, 9000, 3)]}, "balance": {"$gt": 0}},
    )


@registered("""
SELECT c_custkey AS customer, c_name AS name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')
""")
def ent_ids_from_tables(spark, sf_dir):
    """Ids by the table: one that must hold them, and one that must not."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id")
    return query(
        trade_dataset(spark, sf_dir, "customer_entities"), "entities", ["customer"], ["name"],
        where={"$and": [{"customer": {"$in": urgent}}, {"customer": {"$nin": failed}}]},
    )
