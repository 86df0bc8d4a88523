"""An optional streaming front-end for the event log. The reference has no streams; this goes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in tumbling windows; what comes later than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", kind, "n", "total")


def first_deliveries(events: DataFrame, key: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark, however often it is delivered."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str = "append"):
    """The stream over all that is there now, into a table in memory; for tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
