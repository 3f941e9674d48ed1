"""Histories, renames and digests against each version and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from dimlens.operators.digests import DIGESTS, differing_leaves, digest_diff, store_with_digests
from dimlens.operators.history import SINCE, UNTIL, as_of, history_between, version_history, with_version
from dimlens.operators.renames import column_renames, key_renames, versions_renamed
from dimlens.operators.versions import version_diff
from tests.company import explained, found

SCHEMA = "k string, j int, v int, w string"


def versions(spark, seed, n=6):
    chance = random.Random(seed)
    rows = {(f"k{i}", j): (chance.choice([None, 1, 2]), chance.choice(["", None, "x"])) for i in range(6) for j in (1, 2)}
    out = []
    for _ in range(n):
        held = {k: c for k, c in rows.items() if chance.random() < 0.8}
        out.append(spark.createDataFrame([(*k, *c) for k, c in held.items()], SCHEMA))
        for k in chance.sample(list(rows), 3):
            rows[k] = (chance.choice([None, 1, 2]), chance.choice(["", None, "x"]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_every_version_can_be_read_back(spark, tmp_path, seed):
    given = versions(spark, seed)
    history = version_history(given, ["k", "j"])
    path = str(tmp_path / "history")
    history.write.parquet(path)
    stored = spark.read.parquet(path)
    for number, rows in enumerate(given):
        assert found(as_of(stored, number)) == found(rows)
    assert as_of(stored, len(given)).count() == given[-1].count()
    # Neighbouring versions never hold the same row twice.
    rows = sorted(stored.collect(), key=lambda r: (r.k, r.j, r[SINCE]))
    for a, b in zip(rows, rows[1:], strict=False):
        if (a.k, a.j) == (b.k, b.j):
            assert a[UNTIL] is not None and a[UNTIL] <= b[SINCE]
            assert a[UNTIL] < b[SINCE] or (a.v, a.w) != (b.v, b.w)


def test_added_versions_equal_all_at_once(spark, tmp_path):
    given = versions(spark, 9)
    history = version_history(given[:1], ["k", "j"])
    for number, rows in enumerate(given[1:], 1):
        path = str(tmp_path / str(number))
        with_version(history, rows, number, ["k", "j"]).write.parquet(path)
        history = spark.read.parquet(path)
    columns = ["k", "j", "v", "w", SINCE, UNTIL]
    whole = version_history(given, ["k", "j"])
    assert found(history.select(*columns)) == found(whole.select(*columns))
    events = history_between(whole, 1, 3).collect()
    assert {(r.change, r.version) for r in events} <= {(c, v) for c in ("began", "ended") for v in (2, 3)}
    began = {(r.k, r.j) for r in events if (r.change, r.version) == ("began", 2)}
    diff = version_diff(given[1], given[2], ["k", "j"]).filter("change <> 'removed'")
    assert began == {(r.k, r.j) for r in diff.collect()}


def test_columns_that_come_and_go(spark):
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    two = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    history = version_history([one, two, one], ["k"])
    assert set(found(history)) == {("a", 1, None, 0, 1), ("a", 1, None, 2, None), ("a", 1, "x", 1, 2), ("b", 2, None, 1, 2)}
    steps = with_version(with_version(version_history([one], ["k"]), two, 1, ["k"]), one, 2, ["k"])
    assert found(steps.select("k", "v", "w", SINCE, UNTIL)) == found(history)


def test_reading_a_version_skips_rows_in_the_scan(spark, tmp_path):
    version_history(versions(spark, 1), ["k", "j"]).write.parquet(str(tmp_path / "h"))
    plan = explained(as_of(spark.read.parquet(str(tmp_path / "h")), 2))
    assert "LessThanOrEqual(valid_from,2)" in plan and "Exchange" not in plan


def test_renamed_keys(spark):
    old = [("company_size", "Size", 5, "a"), ("mic", "Microsoft", 1975, "a"), ("gone", "Gone", 7, "a"),
           ("same", "Same", 8, "a"), ("empty", None, None, None)]
    new = [("company_scale", "Size", 5, "a"), ("mcrsft", "Microsoft", 1976, "a"), ("came", "Came", 9, "a"),
           ("same", "Changed", 8, "a"), ("blank", None, None, None)]
    schema = "id string, name string, n int, kind string"
    old, new = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    renames = key_renames(old, new, "id", least=0.3)
    assert found(renames.select("old_key", "new_key")) == [("company_size", "company_scale"), ("mic", "mcrsft")]
    assert {r.old_key: r.agreement for r in renames.collect()}["company_size"] == 1.0
    left = version_diff(versions_renamed(old, new, "id", renames), new, ["id"])
    assert found(left) == [("blank", "created", ""), ("came", "created", ""), ("empty", "removed", ""),
                           ("gone", "removed", ""), ("mcrsft", "changed", "n"), ("same", "changed", "name")]


def test_ties_go_to_the_smaller_key_and_frequent_values_name_nobody(spark):
    schema = "id string, name string, kind string"
    old = spark.createDataFrame([("a", "twin", "x"), ("b", "twin", "x")] + [(f"o{i}", None, "many") for i in range(40)], schema)
    new = spark.createDataFrame([("c", "twin", "x"), ("d", "twin", "x")] + [(f"n{i}", None, "many") for i in range(40)], schema)
    assert found(key_renames(old, new, "id").select("old_key", "new_key")) == [("a", "c")]
    assert "CartesianProduct" not in explained(key_renames(old, new, "id"), "simple")
    assert "BroadcastNestedLoopJoin" not in explained(key_renames(old, new, "id"), "simple")
    assert key_renames(old, old, "id").collect() == []


def test_renamed_columns(spark):
    old = spark.createDataFrame([(i, f"n{i}", i, "same") for i in range(10)], "k int, name string, size int, kept string")
    new = spark.createDataFrame([(i, f"n{i}" if i else "", "same", float(i % 3)) for i in range(10)],
                                "k int, title string, kept string, other double")
    assert found(column_renames(old, new, ["k"])) == [("name", "title", 0.9)]
    assert column_renames(old, old, ["k"]).collect() == []
    assert column_renames(old.limit(0), new, ["k"]).collect() == []


def numbered(spark, n, change=lambda i: 0):
    return spark.createDataFrame([(i, None if i % 11 == 0 else i + change(i), f"w{i % 5}") for i in range(n)],
                                 "k long, v long, w string").repartition(3)


def test_digests_find_what_the_difference_finds(spark, tmp_path):
    old = numbered(spark, 2000)
    new = numbered(spark, 2003, lambda i: 1 if i in (5, 700, 11) else 0).filter("k <> 44")
    for name, rows in (("old", old), ("new", new)):
        store_with_digests(rows, ["k"], str(tmp_path / name), buckets=8, leaves=64)
    paths = str(tmp_path / "old"), str(tmp_path / "new")
    assert found(digest_diff(spark, *paths, ["k"])) == found(version_diff(old, new, ["k"]))
    assert 0 < differing_leaves(spark, *paths).count() <= 6
    assert spark.read.parquet(f"{paths[0]}/{DIGESTS}").count() <= 8 * 64
    # Rows of other leaves are dropped where they are read.
    diff = digest_diff(spark, *paths, ["k"])
    plan = explained(diff)
    assert plan.index("LeftSemi") > 0 and "PartitionFilters: [__bucket" in plan
    moved = [spark.read.parquet(f"{p}/rows").join(differing_leaves(spark, *paths), ["__bucket", "__leaf"], "left_semi").count()
             for p in paths]
    assert max(moved) < 60


def test_equal_versions_read_nothing(spark, tmp_path):
    for name in ("old", "new"):
        store_with_digests(numbered(spark, 100), ["k"], str(tmp_path / name), 4, 4)
    diff = digest_diff(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["k"])
    assert diff.collect() == [] and diff.columns == ["k", "change", "columns"]
    store_with_digests(numbered(spark, 100).withColumn("extra", F.lit(1)), ["k"], str(tmp_path / "more"), 4, 4)
    assert digest_diff(spark, str(tmp_path / "old"), str(tmp_path / "more"), ["k"]).count() == 100
    store_with_digests(numbered(spark, 100), ["k"], str(tmp_path / "other"), 2, 8)
    with pytest.raises(Exception, match="buckets of different numbers"):
        digest_diff(spark, str(tmp_path / "old"), str(tmp_path / "other"), ["k"]).collect()
