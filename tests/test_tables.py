import datetime

import pytest
from pyspark.sql import functions as F

from dimlens.operators.documents import translate_properties
from dimlens.operators.latest import latest_per_key
from dimlens.operators.order import guard_rows, order_rows
from dimlens.operators.predicates import IdJoin, mark_join, semi_join
from dimlens.operators.versions import apply_changes, version_diff
from dimlens.streaming.changes import current_rows, fold_changes, read_changes, store_changes
from tests.company import explained, found, listed


def at(hour):
    return datetime.datetime(2024, 1, 1, hour)


def test_latest_per_key(spark):
    rows = spark.createDataFrame(
        [("a", at(1), 1), ("a", at(5), 2), ("a", at(5), 3), ("b", at(2), 4), ("c", at(4), 5)],
        "host string, time timestamp, n int")
    latest = latest_per_key(rows, ["host"], "time", "2 hours", tie_breakers=["n"])
    assert listed(latest) == [("a", at(5), 3), ("c", at(4), 5)]
    fixed = latest_per_key(rows, ["host"], "time", "2 hours", now=at(3))
    assert {r[0] for r in found(fixed)} == {"a", "b", "c"}
    assert latest_per_key(rows, ["host"], "time", tie_breakers=["n"]).count() == 3


def test_version_diff(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")],
                                "k string, n int, s string")
    new = spark.createDataFrame([("a", 1, "x", None), ("b", 5, "y", 1), ("d", 4, "w", None)],
                                "k string, n int, s string, extra int")
    assert found(version_diff(old, new, ["k"])) == [
        ("b", "changed", "n,s,extra"), ("c", "removed", ""), ("d", "created", "")]
    assert version_diff(old, old, ["k"]).count() == 0


CHANGES = [
    ("a", 10, 1, False), ("a", 11, 3, False), ("a", 12, 2, False),
    ("b", None, 4, True), ("c", 30, 5, True), ("c", 31, 6, False), ("e", 50, 7, False),
]
EXPECTED = [("a", 11), ("c", 31), ("d", 4), ("e", 50)]


def tables(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int")
    changes = spark.createDataFrame(CHANGES, "k string, v int, seq int, gone boolean")
    return base, changes


def test_apply_changes(spark):
    base, changes = tables(spark)
    assert found(apply_changes(base, changes, ["k"], ["seq"], "gone")) == EXPECTED
    assert found(apply_changes(base, changes.filter("seq < 0"), ["k"], ["seq"])) == found(base)


def test_change_stream_survives_a_restart(spark, tmp_path):
    base, changes = tables(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "changes")
    assert found(current_rows(base, path, ["k"], ["seq"], "gone")) == found(base)
    late, early = changes.filter("seq > 3"), changes.filter("seq <= 3")
    for part in (late, early):  # the older changes arrive last
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).parquet(source)
        store_changes(stream, ["k"], ["seq"], path, str(tmp_path / "state")).awaitTermination()
    assert found(current_rows(base, path, ["k"], ["seq"], "gone")) == EXPECTED
    stored = spark.read.parquet(path)
    assert stored.groupBy("change_batch", "k").count().filter("count > 1").count() == 0


def test_document_translation(spark):
    rows = spark.sql("""
        SELECT 1 AS id, map('name', 'ex', 'more', 'm') AS p, map('en', map('name', '')) AS l
        UNION ALL SELECT 2, map('name', 'why'), map('en', map())
        UNION ALL SELECT 3, map('name', 'zed'), NULL
        UNION ALL SELECT 4, map('name', 'w'), map('fr', map('name', 'v'), 'en', map('new', 'n'))""")
    done = rows.select("id", translate_properties(F.col("p"), F.col("l"), "en").alias("p"))
    assert {r.id: r.p for r in done.collect()} == {
        1: {"name": "", "more": "m"}, 2: {"name": "why"}, 3: {"name": "zed"},
        4: {"name": "w", "new": "n"}}
    same = rows.select(translate_properties(F.col("p"), F.col("l"), None).alias("p"))
    assert same.first().p == {"name": "ex", "more": "m"}


def test_guard_after_sort_is_a_top_k(spark):
    rows = guard_rows(order_rows(spark.range(1000), [{"id": "desc"}]), 3)
    assert [r.id for r in rows.collect()] == [999, 998, 997]
    assert "TakeOrderedAndProject" in explained(rows, "simple")


@pytest.mark.parametrize("how", ["left_semi", "mark"])
def test_hot_key_is_split(spark, how):
    """With ids too large to broadcast, the key that holds most rows is split over tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 400_000, 1, 8).select(
            F.when(F.col("id") < 200_000, 7).otherwise(F.col("id")).alias("who"),
            F.rand(1).alias("v"))
        ids = spark.range(0, 300_000, 1, 4).select(F.col("id").alias("who"))
        if how == "mark":
            joined = mark_join(rows, IdJoin("who", ids), "hit").filter("hit OR v < 0")
        else:
            joined = semi_join(rows, IdJoin("who", ids))
        assert joined.count() == 300_000
        joined.collect()
        assert "skew=true" in explained(joined, "simple")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_version_diff_of_a_retyped_column(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "k int, v int, w string")
    new = spark.createDataFrame([(1, "five", "a"), (2, None, "c")], "k int, v string, w string")
    assert found(version_diff(old, new, ["k"])) == [(1, "changed", "v"), (2, "changed", "w")]


def test_partial_changes(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "k int, v string, w string")
    changes = spark.createDataFrame(
        [(1, "new", 1, False), (2, "gone", 1, True), (4, "added", 1, False), (3, "gone", 1, True), (3, "back", 2, False)],
        "k int, v string, seq int, gone boolean")
    assert found(apply_changes(base, changes, ["k"], ["seq"], "gone")) == [
        (1, "new", "x"), (3, "back", None), (4, "added", None)]


def test_stored_batches_fold_into_the_base(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path, key = str(tmp_path / "changes"), ["k"]
    for number, row in enumerate([(1, "one", 1), (2, "two", 2)]):
        spark.createDataFrame([row], "k int, v string, seq int").write.parquet(f"{path}/change_batch={number}")
    last = fold_changes(base, path, key, ["seq"], str(tmp_path / "folded"))
    assert last == 1
    folded = spark.read.parquet(str(tmp_path / "folded"))
    assert found(folded) == [(1, "one"), (2, "two")]
    spark.createDataFrame([(2, "three", 3)], "k int, v string, seq int").write.parquet(f"{path}/change_batch=2")
    assert read_changes(spark, path, last).count() == 1
    assert found(current_rows(folded, path, key, ["seq"], after=last)) == [(1, "one"), (2, "three")]
