"""Change streams with state per key: late and repeated changes are settled once, silent keys leave.

The state of a key is its last row. It is given up as soon as the watermark has passed that row:
whatever the stream still admits is newer. Start such streams inside ``keyed_state``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dimlens.streaming.changes import CLOSED

EVENT_TIME = "__event_time"

#: Settings of a session whose streams keep state per key.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _rank(row: Row, order: Sequence[str]) -> tuple:
    """Order of changes, missing parts first, as Spark orders structs."""
    return tuple((row[c] is not None, row[c]) for c in order)


def _milliseconds(moment: int) -> int:
    return moment // 1000


def _plain(rows: DataFrame, time: str, delay: str) -> tuple[DataFrame, T.StructType, dict]:
    """Rows with a watermark and with moments as microseconds, which no time zone shifts on their
    way through the state; the schema of the state, and the columns that make moments of them again."""
    moments = [f.name for f in rows.schema if isinstance(f.dataType, T.TimestampType)]
    marked = rows.withColumn(EVENT_TIME, F.col(f"`{time}`")).withWatermark(EVENT_TIME, delay)
    plain = marked.withColumns({c: F.unix_micros(F.col(f"`{c}`")) for c in moments})
    schema = T.StructType([f for f in plain.schema if f.name != EVENT_TIME])
    return plain, schema, {c: F.timestamp_micros(F.col(f"`{c}`")) for c in moments}


class _Latest(StatefulProcessor):
    """Keeps the last change of a key; hands it on when it is new, or newly closed."""

    def __init__(self, schema: T.StructType, order: Sequence[str]):
        self.schema, self.order = schema, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names, time = self.schema.names, self.order[0]
        before = Row(*names)(*self.last.get()) if self.last.exists() else None
        passed = timerValues.getCurrentWatermarkInMs()
        last, closed = before, before is not None and before[CLOSED]
        for row in rows:
            row = Row(*names)(*[row[n] for n in names])
            if before is None and row[time] is not None and _milliseconds(row[time]) < passed:
                continue  # older than all that is still admitted
            closed = closed or row[CLOSED]
            if last is None or _rank(row, self.order) > _rank(last, self.order):
                last = row
        if last is None or (last is before and closed == before[CLOSED]):
            return
        last = Row(*names)(*[closed if n == CLOSED else last[n] for n in names])
        self.last.update(tuple(last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last[time] is not None:
            self.handle.registerTimer(_milliseconds(last[time]) + 1)
        yield last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_changes(
    changes: DataFrame, key: Sequence[str], order: Sequence[str], delay: str, removed: str | None = None
) -> DataFrame:
    """A stream of the last change of each key, whenever it becomes another one.

    ``order`` starts with the event time, a timestamp; changes may come in any order up to ``delay``, an
    interval, and more than once. A change that is older than one known already leaves nothing, so
    only keys that changed reach the sink, once per batch. The column ``CLOSED`` tells whether any
    change so far removed the key. Store the result with ``changes.store_changes``; read back, it
    gives the rows of the batch operator.
    """
    gone = F.coalesce(F.col(f"`{removed}`"), F.lit(False)) if removed else F.lit(False)
    plain, schema, moments = _plain(changes.withColumn(CLOSED, gone), order[0], delay)
    return plain.groupBy(*key).transformWithState(
        _Latest(schema, order), schema, "Update", "EventTime").withColumns(moments)


class _Silent(StatefulProcessor):
    """Keeps the rows of a key until it is known whether another one follows within the span."""

    def __init__(self, schema: T.StructType, order: Sequence[str], span: int):
        self.schema, self.order, self.span = schema, list(order), span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)

    def _rows(self) -> list[Row]:
        if not self.pending.exists():
            return []
        return [Row(*self.schema.names)(*values) for values in self.pending.get()]

    def _settle(self, rows: list[Row], passed: int) -> Iterator[Row]:
        """Rows whose span the watermark has passed leave the state, the silent ones to the result."""
        time = self.order[0]
        rows = sorted(rows, key=lambda r: _rank(r, self.order))
        settled = 0
        for row, after in zip(rows, [*rows[1:], None][:len(rows)], strict=True):
            due = _milliseconds(row[time]) + self.span
            if due > passed:
                break
            settled += 1
            if after is None or _milliseconds(after[time]) > due:
                yield row
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if settled < len(rows):
            self.pending.put([tuple(r) for r in rows[settled:]])
            self.handle.registerTimer(_milliseconds(rows[settled][time]) + self.span)
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, time = timerValues.getCurrentWatermarkInMs(), self.order[0]
        names = self.schema.names
        fresh = [Row(*names)(*[r[n] for n in names]) for r in rows
                 if r[time] is not None and _milliseconds(r[time]) >= passed]
        yield from self._settle(self._rows() + fresh, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(self._rows(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def silent_keys(rows: DataFrame, key: Sequence[str], order: Sequence[str], span_seconds: int, delay: str) -> DataFrame:
    """A stream of the rows after which their key was silent for more than a span of event time.

    A row leaves once the watermark is ``span_seconds`` past it, found by a timer and not by going
    through all keys. ``order`` starts with the event time, which counts in milliseconds; rows may
    come in any order up to ``delay``. A key that speaks again can fall silent again. Rows without a
    time take no part. State holds the rows of a span and the delay, no more.
    """
    plain, schema, moments = _plain(rows, order[0], delay)
    return plain.groupBy(*key).transformWithState(
        _Silent(schema, order, span_seconds * 1000), schema, "Append", "EventTime").withColumns(moments)


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their state in the store that keyed state needs."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
