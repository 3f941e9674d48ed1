"""Session settings and the shared folder for intermediate files."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(
    cores: int | str = "*",
    partitions: int = 8,
    memory: str = "8g",
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dimlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_DIR, checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name in the storage that the cluster shares.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose executors see
    the same disk, falls back to a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


@functools.lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    """One temporary folder for a local application, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="dimlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def small_table(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> DataFrame:
    """Metadata as a DataFrame that lives in the plan: filtering it starts no job."""
    arrow = to_arrow_schema(schema)
    columns = [
        pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
