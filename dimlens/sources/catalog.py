"""The registry of dataset versions: a map of repositories, branches and commits.

A registry is a DataFrame with ``repo string`` and ``branches map<string, array<string>>``, the
newest commit of a branch first.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimlens.errors import DatasetError

BRANCHES_TYPE = "map<string,array<string>>"
# The branch that a bare repository name stands for, and the name of the default.
MAIN_BRANCH = "master"
DEFAULT_ALIAS = "default"


@dataclass(frozen=True)
class Version:
    dataset: str
    branch: str
    commit: str

    def path(self, base: str) -> str:
        folder = f"{self.dataset}/{self.branch}-{self.commit}"
        return f"{base.rstrip('/')}/{folder}" if base else folder


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, Version]:
    """Registry and default version of a JSON configuration file."""
    schema = (
        f"repositoryDescriptors map<string,{BRANCHES_TYPE}>, defaultRepository string, "
        "defaultRepositoryBranch string, defaultRepositoryCommit string"
    )
    file = spark.read.schema(schema).json(path, multiLine=True)
    registry = file.select(F.explode("repositoryDescriptors").alias("repo", "branches"))
    default = file.select(
        "defaultRepository", "defaultRepositoryBranch", "defaultRepositoryCommit"
    ).first()
    return registry, Version(*default)


def registry_from(spark: SparkSession, versions: Mapping[str, Mapping]) -> DataFrame:
    return spark.createDataFrame(list(versions.items()), f"repo string, branches {BRANCHES_TYPE}")


def flatten_catalog(registry: DataFrame, default: Version) -> DataFrame:
    """``(repo, branch, hash, is_head, is_default)``, one row per version."""
    return _positions(registry).select(
        "repo",
        "branch",
        "hash",
        (F.col("pos") == 0).alias("is_head"),
        _is_version(default).alias("is_default"),
    )


def catalog_aliases(registry: DataFrame, default: Version) -> DataFrame:
    """``(alias, repo, branch, hash)`` for every name a version can be asked for by.

    The bare repository name stands for the last commit listed for the main branch, not for its
    head.
    """
    at = [F.col("repo"), F.col("branch")]
    is_head = F.col("pos") == 0
    is_main = (F.col("branch") == MAIN_BRANCH) & (F.col("pos") == F.col("commits") - 1)
    names = F.array_compact(F.array(
        F.when(is_main, F.col("repo")),
        F.when(is_head, F.concat_ws("/", *at)),
        F.when(is_head, F.concat_ws("/", *at, F.lit("HEAD"))),
        F.concat_ws("/", *at, F.col("hash")),
    ))
    aliases = _positions(registry).select(F.explode(names).alias("alias"), "repo", "branch", "hash")
    return aliases.unionByName(
        registry.filter(F.col("repo") == default.dataset).select(
            F.lit(DEFAULT_ALIAS).alias("alias"), "repo",
            F.lit(default.branch).alias("branch"), F.lit(default.commit).alias("hash"),
        )
    )


def catalog_issues(catalog: DataFrame) -> DataFrame:
    """``(issue, repo, rows)``: versions without a repository, repositories with many defaults."""
    unnamed = F.col("repo").isNull() | (F.col("repo") == "")
    missing = (
        catalog.filter(unnamed).groupBy().agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 0)
        .select(F.lit("repository name is empty").alias("issue"),
                F.lit(None).cast("string").alias("repo"), "rows")
    )
    defaults = (
        catalog.filter(~F.coalesce(unnamed, F.lit(True)))
        .groupBy("repo")
        .agg(F.sum(F.col("is_default").cast("bigint")).alias("rows"))
        .filter(F.col("rows") > 1)
        .select(F.lit("more than one default").alias("issue"), "repo", "rows")
    )
    return missing.unionByName(defaults)


def resolve_versions(
    requests: DataFrame, catalog: DataFrame, default: Version, base: str = ""
) -> DataFrame:
    """Add ``path`` and ``error`` to requests ``(dataset, branch, commit)`` with gaps.

    The default fills the gaps; the error says which part of the version does not exist.
    """
    base = f"{base.rstrip('/')}/" if base else ""
    filled = requests.withColumns({
        "dataset": F.coalesce("dataset", F.lit(default.dataset)),
        "branch": F.coalesce("branch", F.lit(default.branch)),
        "commit": F.coalesce("commit", F.lit(default.commit)),
    })
    # Requests shrink to the distinct versions asked for before they meet the catalog.
    asked = filled.select("dataset", "branch", "commit").distinct()
    repos = catalog.select(F.col("repo").alias("__repo")).distinct()
    branches = catalog.select(
        F.col("repo").alias("__repo2"), F.col("branch").alias("__branch")
    ).distinct()
    commits = catalog.select(
        F.col("repo").alias("__repo3"),
        F.col("branch").alias("__branch3"),
        F.col("hash").alias("__hash"),
    ).distinct()
    checked = (
        asked.join(repos, F.col("dataset") == F.col("__repo"), "left")
        .join(branches, (F.col("dataset") == F.col("__repo2"))
              & (F.col("branch") == F.col("__branch")), "left")
        .join(commits, (F.col("dataset") == F.col("__repo3"))
              & (F.col("branch") == F.col("__branch3"))
              & (F.col("commit") == F.col("__hash")), "left")
        .select(
            "dataset", "branch", "commit",
            F.when(F.col("__repo").isNull(), F.lit("no such dataset"))
            .when(F.col("__branch").isNull(), F.lit("no such branch"))
            .when(F.col("__hash").isNull(), F.lit("no such commit"))
            .alias("error"),
        )
        .withColumn("path", F.when(F.col("error").isNull(), F.concat(
            F.lit(base), "dataset", F.lit("/"), "branch", F.lit("-"), "commit")))
    )
    return filled.join(checked, ["dataset", "branch", "commit"])


def resolve_version(
    catalog: DataFrame,
    default: Version,
    dataset: str | None = None,
    branch: str | None = None,
    commit: str | None = None,
) -> Version:
    """One version, with gaps filled by the default; raises when a part does not exist."""
    version = Version(
        dataset or default.dataset, branch or default.branch, commit or default.commit
    )
    in_dataset = F.col("repo") == version.dataset
    in_branch = in_dataset & (F.col("branch") == version.branch)
    found = catalog.agg(
        F.bool_or(in_dataset).alias("dataset"),
        F.bool_or(in_branch).alias("branch"),
        F.bool_or(in_branch & (F.col("hash") == version.commit)).alias("commit"),
    ).first()
    for part in ("dataset", "branch", "commit"):
        if not found[part]:
            given = {"dataset": dataset, "branch": branch, "commit": commit}[part]
            origin = "" if given else "default "
            raise DatasetError(f"no {origin}{part} {getattr(version, part)!r} was found")
    return version


def registry_json(registry: Mapping, default: Version) -> str:
    """The configuration file that :func:`read_registry` reads."""
    return json.dumps({
        "repositoryDescriptors": registry,
        "defaultRepository": default.dataset,
        "defaultRepositoryBranch": default.branch,
        "defaultRepositoryCommit": default.commit,
    })


def _positions(registry: DataFrame) -> DataFrame:
    """One row per commit: its place in its branch, and how many the branch has."""
    return registry.select("repo", F.explode("branches").alias("branch", "hashes")).select(
        "repo", "branch", F.size("hashes").alias("commits"),
        F.posexplode("hashes").alias("pos", "hash"),
    )


def _is_version(version: Version) -> Column:
    return F.coalesce(
        (F.col("repo") == version.dataset)
        & (F.col("branch") == version.branch)
        & (F.col("hash") == version.commit),
        F.lit(False),
    )
