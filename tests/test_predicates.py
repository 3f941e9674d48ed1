"""Every operator on missing, empty, zero, false and number-like cells."""

import datetime

import pytest
from pyspark.sql import functions as F

from dimlens.errors import QueryError
from dimlens.operators.predicates import (
    Bounds,
    IdJoin,
    column_bounds,
    compile_condition,
    predicate,
    referenced_fields,
)
from tests.company import explained


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        (1, "abc", 5.0, True, 2015, datetime.date(2015, 1, 1), ["a", "b"]),
        (2, "2015", 0.0, False, 2016, datetime.date(2016, 5, 2), ["b"]),
        (3, "", None, None, None, None, None),
        (4, None, -1.5, True, 0, datetime.date(1999, 1, 1), []),
        (5, " 10 ", 1e3, False, -3, datetime.date(2020, 1, 1), ["c", "a", "b"]),
    ]
    schema = ("id int, text string, number double, flag boolean, whole int, day date, "
              "tags array<string>")
    return spark.createDataFrame(rows, schema)


def ids(cells, where):
    filtered = cells.filter(predicate(where, cells))
    plain = compile_condition(where, cells).apply(cells)
    kept = sorted(r.id for r in filtered.collect())
    assert kept == sorted(r.id for r in plain.collect())
    return kept


@pytest.mark.parametrize("where, expected", [
    ({"text": "abc"}, [1]),
    ({"text": 2015}, [2]),
    ({"text": {"$eq": "2015"}}, [2]),
    ({"text": 10}, [5]),
    ({"text": None}, [3, 4]),
    ({"text": ""}, [3, 4]),
    ({"text": {"$ne": "abc"}}, [2, 3, 4, 5]),
    ({"text": {"$gt": "2"}}, [1, 2]),
    ({"text": {"$gte": 2015}}, [2]),
    ({"text": {"$lt": "b"}}, [1, 2, 5]),
    ({"text": {"$lt": 100}}, [5]),
    ({"text": {"$in": ["abc", 2015]}}, [1]),
    ({"text": {"$nin": ["abc"]}}, [2, 3, 4, 5]),
    ({"number": 0}, [2]),
    ({"number": "5"}, [1]),
    ({"number": {"$ne": 5}}, [2, 3, 4, 5]),
    ({"number": {"$gt": -1}}, [1, 2, 5]),
    ({"number": {"$lte": "0"}}, [2, 4]),
    ({"number": {"$gt": "x"}}, []),
    ({"number": {"$in": [5, 1000, "0"]}}, [1, 5]),
    ({"number": {"$nin": [5]}}, [2, 3, 4, 5]),
    ({"number": {"$not": {"$gt": 0}}}, [2, 3, 4]),
    ({"flag": True}, [1, 4]),
    ({"flag": False}, [2, 5]),
    ({"flag": {"$ne": True}}, [2, 3, 5]),
    ({"flag": 1}, [1, 4]),
    ({"flag": {"$in": [False]}}, [2, 5]),
    ({"flag": {"$gte": 0}}, [1, 4]),
    ({"whole": {"$gt": "2015"}}, [2]),
    ({"whole": {"$gte": 2015}}, [1, 2]),
    ({"day": {"$gte": "2016-01-01"}}, [2, 5]),
    ({"day": "1999-01-01"}, [4]),
    ({"day": {"$gt": "soon"}}, []),
    ({"$or": [{"text": "abc"}, {"number": {"$lt": 0}}]}, [1, 4]),
    ({"$nor": [{"text": "abc"}, {"number": {"$lt": 0}}]}, [2, 3, 5]),
    ({"$not": {"number": {"$gt": 0}, "flag": True}}, [2, 3, 4, 5]),
    ({"$and": [{"flag": True}, {"$or": [{"number": 5}, {"whole": 0}]}]}, [1, 4]),
    ({"$or": []}, []),
    ({}, [1, 2, 3, 4, 5]),
    ({"text": {}}, [1, 2, 3, 4, 5]),
    ({"tags": {"$size": 2}}, [1]),
    ({"tags": {"$all": ["a", "b"]}}, [1, 5]),
    ({"tags": {"$elemMatch": {"$gt": "b"}}}, [5]),
    ({"tags": {"$elemMatch": "b"}}, [1, 2, 5]),
    ({"absent": {"$nin": [1]}}, [1, 2, 3, 4, 5]),
    ({"absent": {"$in": [1]}}, []),
    ({"absent": None}, [1, 2, 3, 4, 5]),
])
def test_operator(cells, where, expected):
    assert ids(cells, where) == expected


@pytest.mark.parametrize("where", [
    {"text": {"$like": "a"}}, {"$xor": []}, {"a.b": 1}, {"text": "$nothing"},
    {"text": {"$size": 1}}, {"text": {"$gt": [1]}}, {"text": {"$in": "abc"}}, {"number": {"$nin": 5}}, {"number": {"$in": 5}},
])
def test_rejected(cells, where):
    with pytest.raises(QueryError):
        predicate(where, cells)
    with pytest.raises(QueryError):
        compile_condition(where, cells)


def test_filters_reach_the_scan(spark, cells, tmp_path):
    cells.write.parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    rows = compile_condition(
        {"$and": [{"text": {"$gt": "a"}}, {"number": {"$gte": 1}}, {"whole": 2015}]}, stored
    ).apply(stored).select("id")
    plan = explained(rows)
    for pushed in ("GreaterThan(text,a)", "GreaterThanOrEqual(number,1.0)", "EqualTo(whole,2015)"):
        assert pushed in plan


@pytest.mark.parametrize("padding", [0, 3000])
def test_lists_of_any_length_give_the_same_rows(spark, padding):
    rows = spark.createDataFrame(
        [(0, "a", 1.0, datetime.date(2020, 1, 1)), (1, "", 2.0, None), (2, None, None, datetime.date(2021, 1, 1)),
         (3, "b", 4.0, datetime.date(2020, 1, 1))], "id long, text string, number double, day date")

    def ids(where):
        return sorted(r.id for r in compile_condition(where, rows, {}, ["id"]).apply(rows).collect())

    texts = ["", "a", *(f"x{i}" for i in range(padding))]
    numbers = [1, 4, *range(100, 100 + padding)]
    days = ["2020-01-01", *[str(datetime.date(1800, 1, 1) + datetime.timedelta(i)) for i in range(padding)]]
    whole = ["0", 3, *range(100, 100 + padding)]
    for name, members, kept in (("text", texts, [0, 1, 2]), ("number", numbers, [0, 3]),
                                ("day", days, [0, 3]), ("id", whole, [0, 3])):
        rest = sorted({0, 1, 2, 3} - set(kept))
        assert ids({name: {"$in": members}}) == kept
        assert ids({name: {"$nin": members}}) == rest
        assert ids({"$or": [{name: {"$in": members}}, {"id": 1}]}) == sorted({*kept, 1})
        assert ids({name: {"$not": {"$in": members}}}) == rest


def test_ids_in_a_table(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("who"), "id")
    ids = spark.range(5, 15).select(F.col("id").cast("string"))
    where = {"who": {"$in": ids}}
    condition = compile_condition(where, rows)
    assert len(condition.semi_joins) == 1 and not condition.filters
    assert condition.apply(rows).count() == 10
    condition = compile_condition({"$or": [where, {"id": {"$gte": 98}}]}, rows)
    assert len(condition.marks) == 1 and condition.apply(rows).count() == 12
    assert compile_condition({"who": {"$nin": ids}}, rows).apply(rows).count() == 90
    assert compile_condition({"gone": {"$nin": ids}}, rows).apply(rows).count() == 100


def test_one_mark_per_join(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("who"), "id")
    joins = {"$a": IdJoin("who", rows.filter("id < 3").select("who"))}
    where = {"$or": [{"$and": [{"who": "$a"}, {"id": 1}]}, {"$not": {"who": "$a"}}]}
    condition = compile_condition(where, rows, joins)
    assert len(condition.marks) == 1
    assert sorted(r.id for r in condition.apply(rows).collect()) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_numeric_ids_as_text(spark):
    rows = spark.range(10)
    assert compile_condition({"id": {"$in": ["3", "7"]}}, rows, {}, ["id"]).apply(rows).count() == 2
    assert compile_condition({"id": {"$in": ["3", "7"]}}, rows).apply(rows).count() == 0


def test_fields_and_bounds():
    where = {"$and": [{"a": 1}, {"$or": [{"b": {"$gt": 1}}, {"c": "x"}]}], "$not": {"d": 1}}
    assert referenced_fields(where) == ["a", "b", "c", "d"]
    where = {"$and": [{"t": {"$gte": "1996", "$lt": "2000"}}, {"t": {"$in": ["1990", "1998"]}},
                      {"$or": [{"t": "1900"}, {"u": "1"}]}]}
    assert column_bounds(where) == {"t": Bounds("1996", "1998")}


def test_bounds_hold_for_text_and_numbers():
    assert column_bounds({"c": {"$in": ["9", "10"]}}) == {}
    assert column_bounds({"c": {"$in": ["10", "90"]}}) == {"c": Bounds("10", "90")}
    assert column_bounds({"c": {"$in": ["9", "x"]}}) == {}
    assert column_bounds({"c": {"$in": ["a", "b"], "$gte": "aa"}}) == {"c": Bounds("aa", "b")}
    assert column_bounds({"$and": [{"c": {"$gte": "9"}}, {"c": {"$gte": "10"}}]}) == {"c": Bounds("9")}


def test_operands_may_be_generators(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "t string")
    for values in (["a", ""], iter(["a", ""]), {"a", ""}):
        assert compile_condition({"t": {"$in": values}}, rows).apply(rows).count() == 3


def test_long_lists_are_constants_of_one_expression(spark):
    odd = ["it's", 'say "x"', "back\\slash", "new\nline", "\\'", "${x}", "é漢", "plain"]
    rows = spark.createDataFrame([(t, i, i / 2) for i, t in enumerate([*odd, "other", None])], "`t x` string, n int, d double")
    filler = [f"f{i}" for i in range(100)]
    kept = compile_condition({"t x": {"$in": odd + filler}}, rows).apply(rows)
    assert [r[0] for r in kept.collect()] == odd
    assert compile_condition({"t x": {"$nin": odd + filler}}, rows).apply(rows).count() == 2
    numbers = [*range(1000, 1100), 3, 4, 2**70, True]
    assert [r.n for r in compile_condition({"n": {"$in": numbers}}, rows).apply(rows).collect()] == [3, 4]
    assert [r.n for r in compile_condition({"n": {"$in": numbers[:-2]}}, rows).apply(rows).collect()] == [3, 4]
    halves = [float(i) for i in range(900, 1000)] + [0.5, 1.5, float("inf"), 1e300]
    assert [r.n for r in compile_condition({"d": {"$in": halves}}, rows).apply(rows).collect()] == [1, 3]
    assert [r.n for r in compile_condition({"d": {"$in": halves[:-2]}}, rows).apply(rows).collect()] == [1, 3]


def test_long_lists_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "concat('k', id) AS k").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = explained(compile_condition({"k": {"$in": [f"k{i}" for i in range(500)]}}, rows).apply(rows))
    assert "PushedFilters: [In(k" in plan
