"""Streams of postings and events: upserts batch by batch, windowed counts, duplicates within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocandra.operators.postings import deduplicate, normalise, upsert
from vocandra.sources.sinks import KeyedTable


def upsert_batches(store: KeyedTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: normalises, deduplicates and merges each batch of scraped rows into ``store``."""

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("scraped_at").alias("now")).first()["now"]
        if now is None:
            return
        as_of = F.lit(str(now)).cast("timestamp_ntz")
        seen = F.lit(None).cast("timestamp_ntz")
        new = deduplicate(normalise(batch)).withColumn("first_seen", seen).withColumn("last_seen", seen)
        old = store.read()
        store.write(upsert(new.limit(0) if old is None else old, new, as_of).drop("is_new"))

    return each


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """(start, event_type, events, total) per window, late events within ``late``; for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def first_arrivals(rows: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """The first row per key: within the watermark on a stream, of all on a table."""
    if not rows.isStreaming:
        return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), time).alias("r")).select("r.*")
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark([key])
