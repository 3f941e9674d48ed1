from dimlens.functions.keys import key_text
from dimlens.model import Dataset, Resource
from dimlens.model import collect_index
from dimlens.operators.availability import build_availability
from dimlens.operators.reports import (
    dataset_sizes,
    merge_conflicts,
    rejected_cells,
    unknown_columns,
)
from dimlens.plans.query import query
from tests import company
from tests.company import found, text_table


def test_pairs_of_the_data(firms):
    rows = build_availability(firms).collect()
    pairs = {(r.kind, key_text(r.key), r.value): tuple(r.resources) for r in rows}
    names = {p[1:] for p in pairs if p[0] == "datapoints"}
    dims = ("company", "english_speaking", "foundation")
    assert names == {
        *[(f"anno,{d}" if "anno" < d else f"{d},anno", v) for d in dims
          for v in ("company_size", "lines_of_code")],
        *[(key_text(["anno", d, "project"]), "lines_of_code") for d in dims],
        *[(key_text([d, "project"]), v) for d in dims
          for v in ("lines_of_code", "num_users", "latitude", "longitude")],
    }
    entities = {p[1:] for p in pairs if p[0] == "entities"}
    assert ("foundation", "is--english_speaking") in entities
    assert ("company", "full_name") in entities and ("company_size", "full_name") in entities
    assert ("foundation", "full_name") not in entities
    assert pairs["datapoints", "anno,company", "lines_of_code"] == ("code_by_year",)


def test_found_index_answers_queries(firms):
    indexed = firms.with_index(collect_index(build_availability(firms)))
    for key in (["company", "anno"], ["foundation", "anno"], ["english_speaking", "project"]):
        assert found(query(indexed, "datapoints", key, ["lines_of_code"])) == found(
            query(firms, "datapoints", key, ["lines_of_code"]))


def test_values_that_are_always_empty_are_absent(spark):
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), text_table(
            spark, "concept concept_type domain", [("place", "entity_domain", None),
                                                   ("anno", "time", None), ("v", "measure", None),
                                                   ("w", "string", None)])),
        Resource("d", ("place", "anno"), text_table(spark, "place anno v w", [
            ("a", "2000", "n/a", "x"), ("b", "2001", "", "")])),
    ])
    assert {r.value for r in build_availability(dataset).collect() if r.kind == "datapoints"} == {"w"}
    assert found(rejected_cells(dataset, dataset.resources["d"])) == [("a", "2000", "v", "n/a")]


def test_conflicts_and_sizes(spark, firms):
    other = Resource("late", ("company", "anno"), text_table(
        spark, "company anno lines_of_code extra",
        [("nimbus", "2015", "7", "q"), ("orchard", "2016", "531062", "q")]))
    dataset = Dataset(spark, [*firms.resources.values(), other], name="firms")
    report = merge_conflicts(dataset, ["company", "anno"], ["lines_of_code", "company_size"])
    assert found(report) == [("nimbus", "2015", "lines_of_code")]
    assert found(unknown_columns(dataset)) == [("late", "extra")]
    sizes = dataset_sizes(dataset, ["nl-nl"]).first().asDict()
    assert sizes == {"dataset": "firms", "concepts": 15, "entities": 12, "datapoints": 25,
                     "translations": 10}


def test_disjoint_sets_skip_sibling_files(spark):
    disjoint = company.dataset(spark, disjoint=True)
    assert [r.name for r in disjoint.resolve(["company_size"], ["name"])] == ["companies"]
    assert [r.name for r in disjoint.resolve(["company_size"], ["full_name"])] == ["sizes"]
    both = company.dataset(spark)
    assert [r.name for r in both.resolve(["foundation"], ["full_name"])] == ["sizes"]
    assert disjoint.resolve(["foundation"], ["full_name"]) == []


def test_property_named_like_the_asked_set(spark):
    """A file whose property has the name of the set that its key is renamed to."""
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), text_table(
            spark, "concept concept_type domain",
            [("geo", "entity_domain", None), ("land", "entity_set", "geo"),
             ("zone", "entity_set", "geo"), ("name", "string", None)])),
        Resource("lands", ("land",), text_table(spark, "land zone name is--land",
                                                [("l1", "z1", "Land", "TRUE")])),
        Resource("zones", ("zone",), text_table(spark, "zone name is--zone",
                                                [("z1", "Zone", "TRUE")])),
    ])
    assert found(query(dataset, "entities", ["zone"], ["name"])) == [("z1", "Zone")]
    assert found(query(dataset, "entities", ["geo"], ["zone", "name"])) == [
        ("l1", "z1", "Land"), ("z1", None, "Zone")]


def test_two_sets_of_one_domain_in_a_key(spark):
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), text_table(
            spark, "concept concept_type domain",
            [("geo", "entity_domain", None), ("start", "entity_set", "geo"),
             ("finish", "entity_set", "geo"), ("moves", "measure", None)])),
        Resource("places", ("geo",), text_table(spark, "geo is--start is--finish", [
            ("a", "TRUE", "FALSE"), ("b", "TRUE", "TRUE")])),
        Resource("flows", ("start", "finish"), text_table(spark, "start finish moves", [
            ("a", "b", "3"), ("b", "a", "4")])),
    ])
    rows = query(dataset, "datapoints", ["start", "finish"], ["moves"])
    assert found(rows) == [("a", "b", 3.0)]
