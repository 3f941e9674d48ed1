"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
#: Where the frames that ``stored`` gave lie, as long as they are in use.
_stored_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local sessions without it get a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="dimlens-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors do not cost its work."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    _stored_paths[found] = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete stored frames that nothing will read again; what was written from them stays."""
    for frame in frames:
        if path := _stored_paths.pop(frame, None):
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def texts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Id and whole text, a missing text as an empty one; other columns are left behind."""
    return documents.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_slices(column: pa.Array, work: Callable[[list], list], kind: pa.DataType, rows: int = 512) -> pa.Array:
    """``work`` over a batch's values, few at a time, so that a worker holds few of them as objects."""
    parts = [pa.array(work(column.slice(i, rows).to_pylist()), type=kind) for i in range(0, len(column), rows)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)
