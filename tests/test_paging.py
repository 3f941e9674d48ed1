"""Pages found from the last row of the one before, against the full sort."""

import random

import pytest

from dimlens import Dataset, Resource
from dimlens.errors import QueryError
from dimlens.operators.availability import Memberships, build_availability
from dimlens.operators.order import order_rows, page_rows
from tests.company import explained

SCHEMA = "id int, a double, b string, c boolean"


def rows_of(spark, seed, n=70):
    chance = random.Random(seed)
    rows = [(i, chance.choice([None, 0.5, 1.0, -2.0]), chance.choice([None, "", "x", "y"]), chance.choice([None, True, False]))
            for i in range(n)]
    chance.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def all_pages(rows, order_by, size, ties):
    out, after = [], None
    while True:
        page = page_rows(rows, order_by, size, ties, after).collect()
        out += page
        if len(page) < size:
            return out
        after = page[-1].asDict()


@pytest.mark.parametrize(("order_by", "size"), [
    ([{"a": "desc"}, "b"], 9), (["b", {"c": -1}], 16), (["c"], 70), ([{"id": "desc"}], 23), (None, 31)])
def test_pages_are_the_sorted_rows(spark, order_by, size):
    rows = rows_of(spark, size)
    expected = order_rows(rows, order_by, ["id"]) if order_by else rows.orderBy("id")
    assert all_pages(rows, order_by, size, ["id"]) == expected.collect()


def test_a_page_reaches_the_scan_and_is_a_top_k(spark, tmp_path):
    rows_of(spark, 1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = explained(page_rows(rows, ["a"], 5, ["id"], {"a": 0.5, "id": 3}))
    assert "GreaterThanOrEqual(a,0.5)" in plan and "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    plan = explained(page_rows(rows, [{"a": "desc"}], 5, ["id"], {"a": 0.5, "id": 3}))
    assert "IsNull(a)" in plan.split("PushedFilters: ")[1] and "LessThan" in plan.split("PushedFilters: ")[1]


def test_the_row_has_to_be_whole(spark):
    with pytest.raises(QueryError, match="has no id"):
        page_rows(rows_of(spark, 1), ["a"], 5, ["id"], {"a": 1.0})


def test_many_overlapping_sets_cost_one_row_per_entity(spark):
    """Seventy sets, most of them of every entity: bits, not rows, go through the join."""
    sets = [f"s{i:03}" for i in range(70)]
    concepts = spark.createDataFrame(
        [("place", "entity_domain", None), ("anno", "time", None), ("v", "measure", None), ("w", "string", None)]
        + [(s, "entity_set", "place") for s in sets], "concept string, concept_type string, domain string")
    flags = [(f"p{i}", *[(i + j) % 50 != 0 or j < 3 for j in range(70)]) for i in range(6)]
    entities = spark.createDataFrame(flags, "place string, " + ", ".join(f"`is--{s}` boolean" for s in sets))
    facts = spark.createDataFrame([("p0", "2000", 1.0, None), ("p1", "2000", None, "x"), ("p9", "2000", 2.0, "")],
                                  "place string, anno string, v double, w string")
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts), Resource("places", ("place",), entities),
                              Resource("facts", ("place", "anno"), facts)], disjoint=True)
    rows = build_availability(dataset).filter("kind = 'datapoints'")
    found = {(tuple(sorted(r.key)), r.value) for r in rows.collect()}
    members = {"v": flags[0], "w": flags[1]}
    assert found == {(tuple(sorted(("anno", name))), v) for v, own in members.items()
                     for name in ["place", *[s for s, held in zip(sets, own[1:], strict=True) if held]]}
    names, bits = Memberships(dataset).bits("place")
    assert names == sets and bits.count() == 6 and len(bits.columns) == 1 + 2
    plan = explained(rows, "simple")
    facts_side = plan[plan.index("bit_or"):]
    assert "Generate" not in facts_side.split("Join")[0]
