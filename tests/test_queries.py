import pandas as pd
import pytest
from pyspark.sql import functions as F

from dimlens import Dataset, QueryError, Resource, query, read
from dimlens.functions.keys import key_text
from tests.company import SIZE_BY_YEAR, found, listed, text_table


def code(firms, key=("company", "anno"), **options):
    return query(firms, "datapoints", key, ["lines_of_code"], **options)


def test_plain_datapoints(firms):
    assert found(query(firms, "datapoints", ["company", "anno"], ["company_size"])) == sorted(
        SIZE_BY_YEAR, key=repr
    )


def test_measures_are_numbers_and_empty_cells_null(firms):
    rows = query(firms, "datapoints", ["company", "project"], ["num_users", "latitude"],
                 where={"project": "server"})
    assert found(rows) == [("orchard", "server", 8567.0, 59.3), ("valley", "server", 5435.0, None)]


def test_two_files_become_one_table(firms):
    rows = query(firms, "datapoints", ["company", "anno"], ["company_size", "lines_of_code"])
    assert found(rows) == sorted([
        ("nimbus", "1975", "small", None), ("nimbus", "2015", "large", 62493.0),
        ("nimbus", "2016", "large", 49595.0), ("orchard", "2015", "small", 496533.0),
        ("orchard", "2016", "small", 531062.0),
    ], key=repr)


@pytest.mark.parametrize("where, expected", [
    ({"$and": [{"lines_of_code": {"$gt": 50000}}, {"anno": {"$gt": 2014, "$lt": 2016}}]},
     [("nimbus", "2015"), ("orchard", "2015")]),
    ({"anno": {"$gte": "2016"}}, [("nimbus", "2016"), ("orchard", "2016")]),
    ({"$nor": [{"anno": "2016"}, {"company": {"$in": ["nimbus"]}}]}, [("orchard", "2015")]),
    ({"anno": {"$not": {"$eq": "2016"}}, "company": {"$ne": "orchard"}}, [("nimbus", "2015")]),
    ({"$not": {"anno": "2016"}}, [("nimbus", "2015"), ("orchard", "2015")]),
    ({"anno": {"$in": [2015]}}, []),
    ({"anno": {"$eq": 2015}, "company": "nimbus"}, [("nimbus", "2015")]),
    ({"anno": {"$or": [{"$lt": "2016", "$gt": "2015"}, {"$eq": "2016"}]}},
     [("nimbus", "2016"), ("orchard", "2016")]),
    ({"lines_of_code": {"$gt": "60000"}, "anno": {"$ne": "2016"}},
     [("nimbus", "2015"), ("orchard", "2015")]),
    ({"nowhere": {"$ne": 1}, "company": "nimbus"}, [("nimbus", "2015"), ("nimbus", "2016")]),
    ({"nowhere": 1}, []),
])
def test_conditions(firms, where, expected):
    assert [row[:2] for row in found(code(firms, where=where))] == expected


def test_operators_on_one_field(firms):
    rows = code(firms, ["company", "project"], where={"$and": [
        {"project": {"$ne": "console", "$nin": ["suite"], "$in": ["charts", "server", "nimbus"]}}]})
    assert [r[:2] for r in found(rows)] == [
        ("orchard", "charts"), ("orchard", "server"), ("valley", "server")]


def test_three_dimensions(firms):
    rows = code(firms, ["company", "project", "anno"], where={"$and": [
        {"project": {"$ne": "server"}}, {"company": {"$nin": ["nimbus"]}},
        {"lines_of_code": {"$gt": 450000}}]})
    assert found(rows) == [("orchard", "charts", "2016", 479679.0)]


def test_condition_on_an_unselected_value(firms):
    rows = query(firms, "datapoints", ["company", "anno"], ["lines_of_code"],
                 where={"company_size": "large"})
    assert found(rows) == [("nimbus", "2015", 62493.0), ("nimbus", "2016", 49595.0)]


def test_join_on_entity_property(firms):
    join = {"$company": {"key": "company", "where": {"region": "europe"}},
            "$anno": {"key": "anno", "where": {"anno": {"$in": ["2016"]}}}}
    rows = code(firms, where={"$and": [{"company": "$company"}, {"anno": "$anno"}]}, join=join)
    assert found(rows) == [("orchard", "2016", 531062.0)]


def test_join_inside_or_and_nor(firms):
    join = {"$company": {"key": "company", "where": {"is--foundation": True}}}
    either = code(firms, where={"$or": [{"company": "$company"}, {"anno": "2016"}]}, join=join)
    assert [r[:2] for r in found(either)] == [
        ("nimbus", "2016"), ("orchard", "2015"), ("orchard", "2016")]
    neither = code(firms, where={"$nor": [{"company": "$company"}, {"anno": "2016"}]}, join=join)
    assert [r[:2] for r in found(neither)] == [("nimbus", "2015")]
    assert neither.columns == ["company", "anno", "lines_of_code"]


def test_join_tests_its_own_key(firms):
    join = {"$other": {"key": "project", "where": {}}}
    assert found(code(firms, where={"company": "$other"}, join=join)) == []


def test_set_key_answered_from_domain_files(firms):
    rows = code(firms, ["english_speaking", "project"])
    assert {r[0] for r in found(rows)} == {"nimbus", "orchard"}
    assert rows.columns == ["english_speaking", "project", "lines_of_code"]
    assert {r[0] for r in found(code(firms, ["foundation", "anno"]))} == {"orchard"}


def test_domain_key_answered_from_set_files(firms):
    assert found(query(firms, "entities", ["company"])) == [
        ("large",), ("nimbus",), ("orchard",), ("small",), ("valley",)]
    rows = query(firms, "entities", ["company"], ["full_name", "name"])
    assert ("small", "Not very big", None) in found(rows)


def test_entities_of_a_set(firms):
    rows = query(firms, "entities", ["company_size"], ["full_name", "is--company_size"])
    assert found(rows) == [("large", "VERY BIG", True), ("small", "Not very big", True)]
    rows = query(firms, "entities", ["company"], ["is--english_speaking"],
                 where={"is--english_speaking": False})
    assert found(rows) == [("valley", False)]


def test_key_and_value_named_alike_come_once(firms):
    rows = query(firms, "entities", ["company"], ["company", "is--foundation"],
                 where={"is--foundation": True})
    assert rows.columns == ["company", "is--foundation"]


def test_concepts(firms):
    rows = query(firms, "concepts", ["concept"], ["concept_type", "domain"],
                 where={"concept_type": {"$eq": "entity_set"}}, order_by=["concept"])
    assert listed(rows) == [
        ("company_size", "entity_set", "company"), ("english_speaking", "entity_set", "company"),
        ("foundation", "entity_set", "company")]
    assert len(found(query(firms, "concepts", ["concept"], ["domain"], where={"domain": None}))) == 12


def test_order(firms):
    rows = query(firms, "datapoints", ["company", "anno"], ["company_size"],
                 order_by=[{"anno": "desc"}, "company_size"])
    assert listed(rows) == [
        ("nimbus", "2016", "large"), ("orchard", "2016", "small"), ("nimbus", "2015", "large"),
        ("orchard", "2015", "small"), ("nimbus", "1975", "small")]
    ascending = query(firms, "entities", ["company"], ["country"], order_by=[{"country": 1}, "company"])
    assert [r[1] for r in listed(ascending)] == [None, "Sweden", "USA"]
    unselected = query(firms, "entities", ["region"], order_by=["full_name"])
    assert len(listed(unselected)) == 2


def test_translations(firms):
    rows = query(firms, "entities", ["company"], ["name", "country", "full_name"], language="nl-nl")
    assert found(rows) == [
        ("large", None, None, "HEEL GROOT"), ("nimbus", "Nimbus", "Verenigde Staten", None),
        ("orchard", "Boomgaard", "Zweden", None), ("small", None, None, "Niet heel groot"),
        ("valley", "Valley", None, None)]
    sizes = query(firms, "datapoints", ["company", "anno"], ["company_size"], language="nl-nl")
    assert {r[2] for r in found(sizes)} == {"klein", "groot"}
    same = query(firms, "entities", ["region"], ["full_name"], language="xx")
    assert found(same) == found(query(firms, "entities", ["region"], ["full_name"]))


def test_schema_views(firms):
    pairs = [(key_text(r[0]), r[1]) for r in found(query(firms, "entities.schema", ["key", "value"]))]
    assert ("company", "full_name") in pairs and ("company_size", "full_name") in pairs
    everything = query(firms, "*.schema", ["key", "value"])
    parts = [query(firms, f"{k}.schema", ["key", "value"]).count()
             for k in ("concepts", "entities", "datapoints")]
    assert everything.count() == sum(parts)
    ordered = query(firms, "datapoints.schema", ["key", "value"], order_by=[{"value": "desc"}])
    values = [r[1] for r in listed(ordered)]
    assert values == sorted(values, reverse=True)


def test_schema_array_conditions(firms):
    rows = query(firms, "datapoints.schema", ["key", "value"], where={"key": {"$size": 3}})
    assert {len(r[0]) for r in listed(rows)} == {3}
    rows = query(firms, "datapoints.schema", ["key", "value"],
                 where={"key": {"$all": ["company", "anno"]}})
    assert {tuple(r[0]) for r in listed(rows)} == {("anno", "company"), ("anno", "company", "project")}
    rows = query(firms, "*.schema", ["key", "value"], where={"key": {"$elemMatch": {"$gt": "projecs"}}})
    assert all(any(p > "projecs" for p in r[0]) for r in listed(rows))


def test_schema_statistics(firms):
    rows = query(firms, "datapoints.schema", ["key", "value"],
                 ["min(value)", "max(value)", "avg(value)"])
    stats = {(key_text(r[0]), r[1]): tuple(r[2:]) for r in listed(rows)}
    assert stats["anno,company", "lines_of_code"] == (49595.0, 531062.0, 284920.75)
    assert stats["anno,company", "company_size"] == (None, None, None)
    assert stats["anno,foundation", "lines_of_code"] == (496533.0, 531062.0, 513797.5)
    assert stats["company,project", "latitude"] == (59.3, 59.3, 59.3)


def test_request_mapping(firms):
    request = {
        "from": "datapoints", "select": {"key": ["company", "anno"], "value": ["lines_of_code"]},
        "where": {"anno": "2015"}, "animatable": "anno", "grouping": {}, "force": True,
        "order_by": ["company"], "join": {},
    }
    assert [r[0] for r in listed(read(firms, request))] == ["nimbus", "orchard"]
    doubled = read(firms, request, parsers={"lines_of_code": lambda c: c * 2},
                   transformer=lambda rows: rows.filter("lines_of_code > 200000"))
    assert listed(doubled) == [("orchard", "2015", 993066.0)]


@pytest.mark.parametrize("options, problem", [
    (dict(collection="datapoints", key=["company"], value=["lines_of_code"]), "at least two keys"),
    (dict(collection="datapoints", key=["company", "anno"]), "at least one value"),
    (dict(collection="datapoints", key=["anno", "anno"], value=["lines_of_code"]), "repeated keys"),
    (dict(collection="entities", key=["company", "region"]), "exactly one key"),
    (dict(collection="facts", key=["company"]), "unknown collection"),
    (dict(collection="entities", key=["anno"]), "cannot be a key"),
    (dict(collection="entities", key=["company"], value=["wealth"]), "unknown value wealth"),
    (dict(collection="entities.schema", key=["key"]), "exactly the keys"),
    (dict(collection="entities.schema", key=["key", "value"], language="nl-nl"), "no language"),
    (dict(collection="concepts", key=["concept"], join={"$a": {"key": "x"}}), "takes no join"),
    (dict(collection="entities", key=["company"], where={"company": "$gone"}), "unknown join"),
    (dict(collection="entities", key=["company"], where={"company": {"$like": "x"}}),
     "unknown operator"),
    (dict(collection="entities", key=["company"], where={"company.is--x": True}), "dotted"),
    (dict(collection="entities", key=["company"], order_by=[{"company": "up"}]), "direction"),
    (dict(collection="entities", key=["company"], join={"$a": {}}), "needs a key"),
])
def test_rejected_queries(firms, options, problem):
    with pytest.raises(QueryError, match=problem):
        query(firms, **options)


def test_unknown_value_is_empty_when_not_strict(firms):
    rows = query(firms, "entities", ["region"], ["wealth"], strict=False)
    assert found(rows) == []
    rows = query(firms, "entities", ["region"], ["full_name", "wealth"], strict=False)
    assert {r[2] for r in found(rows)} == {None}


def test_pandas_udf_as_parser(firms):
    @F.pandas_udf("string")
    def shout(cells: pd.Series) -> pd.Series:
        return cells.str.upper()

    request = {"from": "entities", "select": {"key": ["region"], "value": ["full_name"]}}
    assert found(read(firms, request, parsers={"region": shout}))[0][0] == "AMERICA"


def test_ids_outside_the_entities(spark, firms):
    """Datapoints of unknown entities answer the domain, not the sets."""
    extra = Resource("more", ("company", "anno"), text_table(
        spark, "company anno lines_of_code", [("ghost", "2015", "1")]))
    dataset = Dataset(spark, [*firms.resources.values(), extra])
    assert "ghost" in {r[0] for r in found(code(dataset))}
    assert "ghost" not in {r[0] for r in found(code(dataset, ["english_speaking", "anno"]))}
    join = {"$c": {"key": "company", "where": {"is--english_speaking": {"$nin": [False]}}}}
    assert {r[0] for r in found(code(dataset, where={"company": "$c"}, join=join))} == {
        "nimbus", "orchard"}


def test_numeric_dimension_with_text_entities(spark):
    concepts = spark.createDataFrame(
        [("place", "entity_domain"), ("anno", "time"), ("v", "measure"), ("zone", "string")],
        "concept string, concept_type string")
    facts = spark.range(10).select(
        F.col("id").alias("place"), (F.col("id") + 2000).cast("int").alias("anno"),
        F.col("id").cast("string").alias("v"))
    places = spark.range(10).select(
        F.concat(F.lit(""), F.col("id").cast("string")).alias("place"),
        F.when(F.col("id") < 4, "a").otherwise("b").alias("zone"))
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), concepts), Resource("places", ("place",), places),
        Resource("facts", ("place", "anno"), facts, unique=True)])
    rows = query(dataset, "datapoints", ["place", "anno"], ["v"],
                 where={"$and": [{"place": "$p"}, {"anno": {"$gte": "2002"}}]},
                 join={"$p": {"key": "place", "where": {"zone": "a"}}})
    assert found(rows) == [(2, 2002, 2.0), (3, 2003, 3.0)]
