import os

from pyspark.sql import functions as F

from dimlens.llm import membership
from dimlens.llm.membership import separated
from dimlens.llm.storage import discard, stored


def hashed(prefix):
    return F.xxhash64(F.col(f"{prefix}k"), F.col(f"{prefix}v"))


def frame(spark, ids):
    # Column names that the filter uses itself.
    return spark.createDataFrame([(i, f"v{i}" if i is None or i % 7 else None, 1, "x") for i in ids],
                                 "k long, v string, place long, bits string")


def split(spark, ids, members):
    rows = frame(spark, ids)
    known = stored(frame(spark, members).select(hashed("").alias("hash")), "members")
    maybe, never = separated(rows, hashed, known)
    assert maybe.columns == never.columns == rows.columns
    return [r.k for r in maybe.collect()], [r.k for r in never.collect()]


def test_no_member_is_lost_and_few_others_are_taken_for_one(spark):
    maybe, never = split(spark, [*range(4000), None, 5, 5], [*range(0, 4000, 5), None])
    assert sorted([*maybe, *never], key=str) == sorted([*range(4000), None, 5, 5], key=str)
    assert {None, *range(0, 4000, 5)} <= set(maybe) and maybe.count(5) == 3
    assert len(maybe) < 800 + 3 + 3200 / 8


def test_full_filter_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(membership, "ROW", 32768)
    monkeypatch.setattr(membership, "ROWS", 1)
    maybe, never = split(spark, range(3000), range(2000))
    assert set(range(2000)) <= set(maybe) and len(maybe) + len(never) == 3000


def test_nothing_to_find(spark):
    assert split(spark, range(10), []) == ([], list(range(10)))
    assert split(spark, [], range(10)) == ([], [])


def test_texts_do_not_move(spark):
    known = stored(frame(spark, range(9)).select(hashed("").alias("hash")), "members")
    for rows in separated(frame(spark, range(50)), hashed, known):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(place")


def test_discarded_tables_are_gone_and_others_stay(spark):
    one, two = stored(spark.range(5), "one"), stored(spark.range(7), "two")
    path = one.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    discard(one, spark.range(3), one)
    assert not os.path.exists(path) and two.count() == 7
