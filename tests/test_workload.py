"""Every registered query against its SQL, and the plans that matter at scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from dimlens import Dataset, Resource, query
from dimlens.sources.sinks import write_parquet
from dimlens.workload import registry
from dimlens.workload.trade import trade_dataset
from tests.company import explained
from tools.compare import TABLES, normal

SF_DIR = "/root/testdata/sf0.001"
registry.load()
QUERIES = dict(registry.QUERIES)


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, base, name):
    frame = contract.queries()[name](spark, SF_DIR)
    result = base.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert normal(frame.columns, [tuple(r) for r in frame.collect()]) == normal(
        columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["country", "time", "order_count", "shipped_qty"]


def test_time_bounds_reach_the_scans(spark):
    rows = query(
        trade_dataset(spark, SF_DIR), "datapoints", ["country", "time"],
        ["order_count", "shipped_qty"], where={"$and": [{"time": "$time"}]},
        join={"$time": {"key": "time", "where": {"time": {"$gte": "1998", "$lt": "1999"}}}},
    )
    plan = explained(rows)
    assert plan.count("GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)") == 2
    assert plan.count("GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)") == 1
    assert "LessThan(l_shipdate,2000-01-01T00:00)" in plan


def test_null_cases_see_nulls(spark):
    for name in ("dp_two_indicators_merge", "dp_ne_nin_nulls", "dp_not_nor"):
        rows = contract.queries()[name](spark, SF_DIR).collect()
        assert {r.order_count is None for r in rows} == {True, False}
        assert any(r.event_count is None for r in rows)


def test_facts_are_combined_before_they_are_shuffled(spark):
    rows = query(trade_dataset(spark, SF_DIR), "datapoints", ["country", "time"], ["shipped_qty"])
    plan = explained(rows)
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp" in plan
    assert "partial_sum(l_quantity" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["dp_semi_join_property", "dp_large_domain_semi_join", "dp_large_set_key"])
def test_ids_limit_the_facts_before_they_are_shuffled(spark, name):
    """Without a broadcast too, the semi-join comes before anything is aggregated or merged."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in names:
        spark.conf.set(setting, "-1")
    try:
        plan = explained(contract.queries()[name](spark, SF_DIR), "simple")
    finally:
        for setting in names:
            spark.conf.unset(setting)
    if name == "dp_semi_join_property":
        assert plan.index("max_by") < plan.index("LeftSemi")
    else:
        assert plan.index("sum(") < plan.index("LeftSemi") < plan.index("orders")


def test_constraints_prune_partitions(spark, tmp_path):
    """A semi-join on a partition column skips the folders of other ids."""
    source = trade_dataset(spark, SF_DIR)
    path = str(tmp_path / "stored")
    write_parquet(source.resources["shipments_by_country"].frame, path, ["country"])
    kept = [source.resources[n] for n in ("concepts", "country_entities")]
    stored = Resource("stored", ("country", "time"), spark.read.parquet(path))
    rows = query(
        Dataset(spark, [*kept, stored], disjoint=True), "datapoints", ["country", "time"],
        ["shipped_qty"], where={"country": "$c"},
        join={"$c": {"key": "country", "where": {"world_region": "ASIA"}}},
    )
    assert "dynamicpruning" in explained(rows)
    asian = {f"NATION_{i}" for i in (2, 7, 12, 17, 22)}
    assert {r.country for r in rows.collect()} == {
        r.country for r in stored.frame.collect() if r.country in asian}


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_or_python(spark, name):
    plan = explained(contract.queries()[name](spark, SF_DIR), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Window" not in plan
