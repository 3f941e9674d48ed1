"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.operators.merge import last_rows


def latest_per_key(
    rows: DataFrame,
    key: Sequence[str],
    time: str,
    span: str | None = None,
    now: datetime | Column | None = None,
    tie_breakers: Sequence[str] = (),
    newest_first: bool = True,
) -> DataFrame:
    """Latest row of each key no older than ``span`` (such as ``2 days``) before ``now``.

    ``now`` defaults to the newest time in the data. The latest row comes from an aggregation,
    which combines before the shuffle: a key with most of the rows needs no large window.
    """
    if span is not None:
        if now is None:
            now = rows.agg(F.max(time)).scalar()
        elif isinstance(now, datetime):
            now = F.lit(now)
        rows = rows.filter(F.col(time) > now - F.expr(f"INTERVAL {span}"))
    latest = last_rows(rows, key, [time, *tie_breakers]).select(*rows.columns)
    return latest.orderBy(F.col(time).desc(), *key) if newest_first else latest
