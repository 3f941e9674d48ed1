"""Streams over the events, which arrive in batches and out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from dimlens.session import shared_folder
from dimlens.streaming.changes import current_rows, store_changes
from dimlens.streaming.keyed import keyed_state, latest_changes, silent_keys
from dimlens.workload.registry import registered
from dimlens.workload.tables import UPDATES_SQL, _base_and_changes, _changes
from dimlens.workload.trade import table

BATCHES = 3


def _arrivals(spark, sf_dir, folder, rows):
    """Files of rows as they arrive: up to a day after their time, so no batch is in order."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.crc32(F.col("event_id").cast("string")) % 86400 * 1_000_000
    rows = rows.withColumn("arrival", arrival)
    bounds = rows.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).first()
    step = (bounds["high"] - bounds["low"]) // BATCHES + 1
    for batch in range(BATCHES):
        arrived = rows.filter(F.floor((F.col("arrival") - bounds["low"]) / step) == batch)
        arrived.drop("arrival").orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.drop("arrival").schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(folder)


@registered(UPDATES_SQL)
def keyed_updates(spark, sf_dir):
    """Updates out of order, settled by state per user; only users that changed are stored."""
    base, changes = _base_and_changes(spark, sf_dir)
    folder, key, order = shared_folder(spark, "keyed"), ["user_id"], ["ts", "event_id"]
    arriving = _arrivals(spark, sf_dir, f"{folder}/in", changes.drop("removed"))
    with keyed_state(spark):
        latest = latest_changes(_changes(arriving), key, order, "2 days", "removed")
        store_changes(latest, key, order, f"{folder}/changes", f"{folder}/state", removed="removed").awaitTermination()
    return current_rows(base, f"{folder}/changes", key, order, "removed")


@registered("""
WITH following AS (
  SELECT *, epoch_ms(ts) + 129600000 AS due,
         lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ms FROM events)
SELECT user_id, event_id, event_type FROM following
WHERE due <= (SELECT max(epoch_ms(ts)) FROM events) - 172800000 AND (next_ms IS NULL OR next_ms > due)
""")
def silent_users(spark, sf_dir):
    """The last event of users before they were silent for a day and a half, found by timers."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    folder = shared_folder(spark, "silent")
    arriving = _arrivals(spark, sf_dir, f"{folder}/in", events)
    with keyed_state(spark):
        silent = silent_keys(arriving, ["user_id"], ["ts", "event_id"], 129600, "2 days")
        silent.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(silent.schema).parquet(f"{folder}/out").select("user_id", "event_id", "event_type")
