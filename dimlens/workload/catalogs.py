"""Version registry queries, on a registry found in the orders table.

Order priorities are the repositories, order states the branches and order months the commits,
newest first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.sources.catalog import (
    Version,
    catalog_aliases,
    catalog_issues,
    flatten_catalog,
    resolve_versions,
)
from dimlens.workload.registry import registered
from dimlens.workload.trade import table

DEFAULT = Version("1-URGENT", "master", "1998-03")
BRANCHES = {"F": "master", "O": "stage", "P": "develop"}

VERSIONS_SQL = """
WITH versions AS (
  SELECT DISTINCT o_orderpriority AS repo,
         CASE o_orderstatus WHEN 'F' THEN 'master' WHEN 'O' THEN 'stage' ELSE 'develop' END
           AS branch,
         strftime(o_orderdate, '%Y-%m') AS hash FROM orders),
catalog AS (
  SELECT repo, branch, hash,
         row_number() OVER (PARTITION BY repo, branch ORDER BY hash DESC) = 1 AS is_head,
         repo = '1-URGENT' AND branch = 'master' AND hash = '1998-03' AS is_default
  FROM versions)
"""


def versions(spark, sf_dir):
    branch = F.lit(None)
    for status, name in BRANCHES.items():
        branch = F.when(F.col("o_orderstatus") == status, name).otherwise(branch)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo"), branch.alias("branch"),
        F.date_format("o_orderdate", "yyyy-MM").alias("hash"), "o_orderdate",
    )


def registry(spark, sf_dir):
    """Bounded by the calendar: distinct months per state and priority."""
    return (
        versions(spark, sf_dir).select("repo", "branch", "hash").distinct()
        .groupBy("repo", "branch")
        .agg(F.sort_array(F.collect_list("hash"), asc=False).alias("hashes"))
        .groupBy("repo")
        .agg(F.map_from_entries(F.collect_list(F.struct("branch", "hashes"))).alias("branches"))
    )


@registered(VERSIONS_SQL + "SELECT repo, branch, hash, is_head, is_default FROM catalog")
def catalog_flat(spark, sf_dir):
    return flatten_catalog(registry(spark, sf_dir), DEFAULT)


@registered(VERSIONS_SQL + """
SELECT 'default' AS alias, '1-URGENT' AS repo, 'master' AS branch, '1998-03' AS hash
WHERE EXISTS (SELECT * FROM versions WHERE repo = '1-URGENT')
UNION ALL SELECT repo, repo, 'master', min(hash) FROM versions WHERE branch = 'master' GROUP BY repo
UNION ALL SELECT repo || '/' || branch, repo, branch, hash FROM catalog WHERE is_head
UNION ALL SELECT repo || '/' || branch || '/HEAD', repo, branch, hash FROM catalog WHERE is_head
UNION ALL SELECT repo || '/' || branch || '/' || hash, repo, branch, hash FROM catalog
""")
def catalog_alias_table(spark, sf_dir):
    return catalog_aliases(registry(spark, sf_dir), DEFAULT)


@registered(VERSIONS_SQL + """
SELECT 'repository name is empty' AS issue, CAST(NULL AS VARCHAR) AS repo, count(*) AS rows
FROM catalog WHERE repo = '4-NOT SPECIFIED' HAVING count(*) > 0
UNION ALL SELECT 'more than one default', repo, count(*) FROM catalog
WHERE repo <> '4-NOT SPECIFIED' AND branch = 'master' AND hash LIKE '1998%'
GROUP BY repo HAVING count(*) > 1
""")
def catalog_check(spark, sf_dir):
    """A registry with unnamed repositories and one default per month of 1998."""
    catalog = flatten_catalog(registry(spark, sf_dir), DEFAULT).select(
        F.nullif(F.col("repo"), F.lit("4-NOT SPECIFIED")).alias("repo"),
        "branch", "hash", "is_head",
        ((F.col("branch") == "master") & F.col("hash").startswith("1998")).alias("is_default"),
    )
    return catalog_issues(catalog)


@registered(VERSIONS_SQL + """,
requests AS (
  SELECT CASE WHEN o_orderpriority = '3-MEDIUM' THEN '1-URGENT'
              WHEN o_orderpriority = '5-LOW' THEN '6-NONE' ELSE o_orderpriority END AS dataset,
         CASE o_orderstatus WHEN 'F' THEN 'master' WHEN 'O' THEN 'stage' ELSE 'master' END
           AS branch,
         strftime(o_orderdate, '%Y-%m') AS "commit" FROM orders),
checked AS (
  SELECT *, CASE WHEN dataset NOT IN (SELECT repo FROM versions) THEN 'no such dataset'
    WHEN (dataset, branch) NOT IN (SELECT repo, branch FROM versions) THEN 'no such branch'
    WHEN (dataset, branch, "commit") NOT IN (SELECT repo, branch, hash FROM versions)
    THEN 'no such commit' END AS error FROM requests)
SELECT dataset, branch, "commit", error,
       CASE WHEN error IS NULL THEN 'base/' || dataset || '/' || branch || '-' || "commit" END
         AS path, count(*) AS requests
FROM checked GROUP BY ALL
""")
def version_resolution(spark, sf_dir):
    """One request per order; gaps take the default, unknown versions are told apart."""
    priority, status = F.col("repo"), F.col("branch")
    requests = versions(spark, sf_dir).select(
        F.when(priority == "3-MEDIUM", None).when(priority == "5-LOW", "6-NONE")
        .otherwise(priority).alias("dataset"),
        F.nullif(status, F.lit("develop")).alias("branch"),
        F.col("hash").alias("commit"),
    )
    catalog = flatten_catalog(registry(spark, sf_dir), DEFAULT)
    resolved = resolve_versions(requests, catalog, DEFAULT, "base/")
    return resolved.groupBy("dataset", "branch", "commit", "error", "path").agg(
        F.count("*").alias("requests")
    )
