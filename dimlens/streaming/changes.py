"""Change streams: every batch is reduced to the last change per key and stored once.

The changes stay beside the base table and are merged when read, so a batch costs what it
brings, not what the base holds. :func:`fold_changes` folds stored batches into the next base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dimlens.operators.versions import CLOSED, COLUMNS, apply_changes

BATCH_FOLDER = "change_batch"


def store_changes(
    stream: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    removed: str | None = None,
) -> StreamingQuery:
    """Write the last change per key of every micro-batch below ``path``.

    A batch that is run again after a lost executor or a restart replaces its own folder, so
    each change counts once. ``checkpoint`` and ``path`` lie in storage shared by the cluster.
    Stored changes say which columns they set and, in ``CLOSED``, whether any change of the batch
    removed the key (``removed`` names the column that tells), so that batches may differ in columns.
    """

    def store(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c != CLOSED]
        gone = F.coalesce(F.col(f"`{removed}`"), F.lit(False)) if removed else F.lit(False)
        if CLOSED in batch.columns:
            gone = gone | F.coalesce(CLOSED, F.lit(False))
        set_by = F.array(*[F.lit(c) for c in columns if c not in key and c not in order])
        values = F.struct(*[F.col(f"`{c}`") for c in columns if c not in key])
        last = batch.groupBy(*key).agg(
            F.max_by(values, F.struct(*order)).alias("__last"), F.bool_or(gone).alias(CLOSED))
        last = last.select(*key, "__last.*", CLOSED, set_by.alias(COLUMNS))
        last.write.mode("overwrite").parquet(f"{path}/{BATCH_FOLDER}={number}")

    return (
        stream.writeStream.foreachBatch(store).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored batches; a column that some of them lack is null there."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_changes(spark: SparkSession, path: str, after: int = -1) -> DataFrame | None:
    """Changes of the batches after number ``after``, None before the first batch.

    The number is a partition column: folders of earlier batches are not read. The columns
    ``COLUMNS`` and ``CLOSED`` are for ``apply_changes``.
    """
    changes = _stored(spark, path)
    return None if changes is None else changes.filter(F.col(BATCH_FOLDER) > after).drop(BATCH_FOLDER)


def current_rows(
    base: DataFrame,
    path: str,
    key: Sequence[str],
    order: Sequence[str],
    removed: str | None = None,
    after: int = -1,
) -> DataFrame:
    """The base table with the stored changes after batch ``after`` applied, the last per key winning."""
    changes = read_changes(base.sparkSession, path, after)
    return base if changes is None else apply_changes(base, changes, key, order, removed)


def fold_changes(
    base: DataFrame,
    path: str,
    key: Sequence[str],
    order: Sequence[str],
    target: str,
    removed: str | None = None,
) -> int:
    """Write the base with all batches stored so far to ``target``; the number of the last one.

    Later reads take ``target`` as base and only batches after that number: see ``read_changes``.
    The batch folders stay for readers of the old base.
    """
    changes = _stored(base.sparkSession, path)
    last = -1 if changes is None else changes.agg(F.max(BATCH_FOLDER)).first()[0]
    rows = base
    if last is not None and last >= 0:
        folded = changes.filter(F.col(BATCH_FOLDER) <= last).drop(BATCH_FOLDER)
        rows = apply_changes(base, folded, key, order, removed)
    rows.write.parquet(target)
    return -1 if last is None else last
