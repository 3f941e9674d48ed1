"""Merging: order, empty cells, absent columns, duplicates, and a chained full join as check."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from dimlens import Dataset, Resource, query
from dimlens.operators.merge import STRICT, TRANSLATION, conflicts, last_rows, merge
from dimlens.operators.reports import repeated_keys
from tests.company import explained, found


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_last_file_wins_and_order_matters(spark):
    a = frame(spark, "k string, v int", ("x", 1), ("y", 2))
    b = frame(spark, "k string, v int", ("x", 9), ("z", 3))
    assert found(merge([a, b], ["k"])) == [("x", 9), ("y", 2), ("z", 3)]
    assert found(merge([b, a], ["k"])) == [("x", 1), ("y", 2), ("z", 3)]


def test_empty_cell_wins_but_absent_column_does_not(spark):
    a = frame(spark, "k string, v int, w string", ("x", 1, "old"))
    b = frame(spark, "k string, v int", ("x", None))
    assert found(merge([a, b], ["k"]).select("k", "v", "w")) == [("x", None, "old")]


def test_one_frame_keeps_duplicates_two_collapse_them(spark):
    a = frame(spark, "k string, v int", ("x", 1), ("x", 2))
    b = frame(spark, "k string, w int", ("y", 3))
    assert merge([a], ["k"]).count() == 2
    ordered = merge([a.coalesce(1), b], ["k"], row_orders=[F.monotonically_increasing_id(), None])
    assert found(ordered) == [("x", 2, None), ("y", None, 3)]


def test_key_only(spark):
    a, b = frame(spark, "k string", ("x",), ("y",)), frame(spark, "k string", ("y",))
    assert found(merge([a, b], ["k"])) == [("x",), ("y",)]


def test_types_that_differ(spark):
    a, b = frame(spark, "k string, v int", ("x", 1)), frame(spark, "k string, v double", ("y", 2.5))
    assert found(merge([a, b], ["k"])) == [("x", 1.0), ("y", 2.5)]
    c = frame(spark, "k int, v string", (7, "n"))
    assert found(merge([a, c], ["k"])) == [("7", "n"), ("x", "1")]


def test_translation_takes_filled_cells_and_adds_rows(spark):
    base = frame(spark, "k string, name string, n int", ("x", "ex", 1), ("y", "why", 2))
    other = frame(spark, "k string, name string", ("x", "iks"), ("y", ""), ("z", "zet"))
    assert found(merge([base, other], ["k"], TRANSLATION)) == [
        ("x", "iks", 1), ("y", "why", 2), ("z", "zet", None)]


def test_strict_merge(spark):
    a = frame(spark, "k string, v int", ("x", 1))
    same = frame(spark, "k string, v int", ("x", 1), ("y", 2))
    other = frame(spark, "k string, v int", ("x", 5))
    assert found(merge([a, same], ["k"], STRICT)) == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="resources disagree on v"):
        merge([a, other], ["k"], STRICT).collect()


def test_conflict_report(spark):
    a = frame(spark, "k string, v int, w string, u int", ("x", 1, "a", 1), ("y", 1, "", 1),
              ("z", None, "q", 1))
    b = frame(spark, "k string, v int, w string", ("x", 2, "a"), ("y", 1, None), ("z", 4, ""))
    assert found(conflicts([a, b], ["k"])) == [("x", "v"), ("z", "v,w")]


def test_last_rows(spark):
    rows = frame(spark, "k string, t int, v string", ("x", 1, "a"), ("x", 3, None), ("y", 2, "b"))
    assert found(last_rows(rows, ["k"], ["t"])) == [("x", 3, None), ("y", 2, "b")]


@pytest.mark.parametrize("seed", range(4))
def test_equals_chained_full_joins(spark, seed):
    chance = random.Random(seed)
    columns = ["a", "b", "c"]
    frames, layouts = [], []
    for _ in range(3):
        held = chance.sample(columns, chance.randint(1, 3))
        keys = [(i, j) for i in range(4) for j in range(4) if chance.random() < 0.6]
        rows = [(f"k{i}", j, *[chance.choice([None, chance.randint(0, 9)]) for _ in held])
                for i, j in keys]
        schema = "k string, j int, " + ", ".join(f"{c} int" for c in held)
        frames.append(spark.createDataFrame(rows, schema))
        layouts.append(held)
    expected = frames[0].withColumn("__0", F.lit(True))
    for place, other in enumerate(frames[1:], 1):
        mark = f"__{place}"
        other = other.withColumn(mark, F.lit(True)).withColumnsRenamed(
            {c: f"{c}_{mark}" for c in layouts[place]})
        expected = expected.join(other, ["k", "j"], "full_outer")
        for c in layouts[place]:
            older = F.col(c) if c in expected.columns else F.lit(None)
            expected = expected.withColumn(c, F.when(F.col(mark), F.col(f"{c}_{mark}")).otherwise(older))
        expected = expected.drop(*[f"{c}_{mark}" for c in layouts[place]])
    wanted = ["k", "j", *sorted({c for held in layouts for c in held})]
    merged = merge(frames, ["k", "j"])
    assert found(merged.select(*wanted)) == found(expected.select(*wanted))


def test_repeated_keys_give_one_row_whatever_the_number_of_frames(spark):
    a = frame(spark, "k string, v int", ("x", 1), ("x", 2), ("y", 5))
    b = frame(spark, "k string, w int, n string", ("x", 3, "p"), ("x", 4, "q"))
    c = frame(spark, "k string, u int", ("x", 7), ("z", 8))
    assert found(merge([a, b], ["k"])) == [("x", 2, 4, "q"), ("y", 5, None, None)]
    assert found(merge([a, b, c], ["k"])) == [
        ("x", 2, 4, "q", 7), ("y", 5, None, None, None), ("z", None, None, None, 8)]
    concepts = frame(spark, "concept string, concept_type string", ("k", "entity_domain"), ("v", "measure"),
                     ("w", "measure"), ("u", "measure"), ("n", "string"))
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts),
                              *[Resource(n, ("k",), f, unique=True) for n, f in (("a", a), ("b", b), ("c", c))]])
    assert found(query(dataset, "entities", ["k"], ["v", "w"])) == [("x", 2, 4), ("y", 5, None)]
    assert found(query(dataset, "entities", ["k"], ["v", "w", "u"])) == [
        ("x", 2, 4, 7), ("y", 5, None, None), ("z", None, None, 8)]
    assert sorted(map(tuple, repeated_keys(dataset).collect())) == [("a", ["x"], 2), ("b", ["x"], 2)]


def test_repeated_keys_report_missing_parts_and_undeclared_resources(spark):
    rows = frame(spark, "k string, j int, v int", ("x", 1, 1), ("x", None, 2), ("y", 1, 3), ("y", 1, 4))
    resources = [Resource("a", ("k", "j"), rows, unique=True), Resource("b", ("k", "j"), rows)]
    assert sorted(map(tuple, repeated_keys(Dataset(spark, resources)).collect()), key=str) == [
        ("a", ["x", None], 1), ("a", ["y", "1"], 2)]
    assert repeated_keys(Dataset(spark, resources[1:])).collect() == []


def test_one_shuffle_and_hash_aggregation(spark, tmp_path):
    for name in ("a", "b", "c"):
        spark.range(100).select("id", F.rand().alias(name)).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / name)) for name in ("a", "b", "c")]
    merged = merge(frames, ["id"]).filter("id = 5")
    plan = explained(merged, "simple")
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    assert plan.count("EqualTo(id,5)") == 3


def test_key_filters_reach_every_resource(spark, tmp_path):
    schema = "place string, anno string, {} double"
    for name in ("v", "w"):
        rows = [(f"p{i}", f"20{i:02}", float(i)) for i in range(20)]
        spark.createDataFrame(rows, schema.format(name)).write.parquet(str(tmp_path / name))
    concepts = spark.createDataFrame(
        [("place", "entity_domain"), ("anno", "time"), ("v", "measure"), ("w", "measure")],
        "concept string, concept_type string")
    dataset = Dataset(spark, [
        Resource("concepts", ("concept",), concepts),
        *[Resource(n, ("place", "anno"), spark.read.parquet(str(tmp_path / n)), unique=True)
          for n in ("v", "w")],
    ])
    rows = query(dataset, "datapoints", ["place", "anno"], ["v", "w"],
                 where={"anno": {"$gte": "2010"}, "w": {"$lt": 15}, "place": {"$ne": "p12"}})
    assert [r[0] for r in found(rows)] == ["p10", "p11", "p13", "p14"]
    plan = explained(rows)
    assert plan.count("GreaterThanOrEqual(anno,2010)") == 2
    assert "SortAggregate" not in plan


def test_row_order_keeps_its_type_and_need_not_be_selected(spark):
    rows = spark.createDataFrame([
        ("x", "new", datetime.datetime(2020, 1, 1, 0, 0, 0, 900000)),
        ("x", "old", datetime.datetime(2020, 1, 1, 0, 0, 0, 100000))], "k string, name string, at timestamp")
    concepts = spark.createDataFrame([("k", "entity_domain"), ("name", "string"), ("at", "string")],
                                     "concept string, concept_type string")
    other = spark.createDataFrame([("y", "other", 1)], "k string, name string, n int")
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts),
                              Resource("a", ("k",), rows.repartition(2), row_order=F.col("at")),
                              Resource("b", ("k",), other, row_order=F.col("n"))])
    found = query(dataset, "entities", ["k"], ["name"]).collect()
    assert sorted(map(tuple, found)) == [("x", "new"), ("y", "other")]


def test_conflicts_without_shared_columns(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([("x", 2)], "k string, b int")
    assert conflicts([a, b], ["k"]).collect() == []
    with pytest.raises(Exception, match="resources disagree on a"):
        merge([a, a.withColumn("a", F.lit(5))], ["k"], STRICT).collect()
    assert merge([a, a.withColumn("b", F.lit(5))], ["k"], STRICT).collect() == [("x", 1, 5)]
