"""Windowed and stateful work on event streams; each form also runs on a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which takes times of a zone, not wall clocks."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, every: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Number and sum of values in windows that follow each other; ``late`` sets the watermark of a stream."""
    return sliding(events, time, every, every, keys, value, late)


def sliding(events: DataFrame, time: str, length: str, every: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    source = marked(events, time, late) if late else events
    counted = source.groupBy(F.window(time, length, every), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Number and sum of values in sessions that end after a gap."""
    source = marked(events, time, late) if late else events
    counted = source.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", "total")


def once_each(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Events of a stream without repeats of a key that come within the watermark."""
    return marked(events, time, late).dropDuplicatesWithinWatermark(keys)


def running_spans(events: DataFrame, key: str, frame: str) -> DataFrame:
    """First and last frame and number of events of each key of a stream, as they become known."""

    def updated(name, batches, state):
        first, last, n = state.get if state.exists else (None, None, 0)
        for rows in batches:
            low, high = int(rows[frame].min()), int(rows[frame].max())
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(rows)
        state.update((first, last, n))
        yield pd.DataFrame({key: [name[0]], "first_frame": [first], "last_frame": [last], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(
        updated, f"{key} long, first_frame long, last_frame long, n long", "first_frame long, last_frame long, n long", "update", "NoTimeout"
    )
