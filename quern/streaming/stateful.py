"""Structured Streaming: keyed sampler state, windows with late data, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def with_event_time(events: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on ``time``; timestamps without a zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def ema_stream(events: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float) -> DataFrame:
    """``key, ema, visits`` after each micro-batch, for keys with new rows; state is two numbers per key.

    Rows of a micro-batch are taken in ``order``; with files in time order the result equals ``ordered_ema`` over all rows.
    """
    schema = f"{key} string, ema double, visits bigint"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, visits = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values(order)  # new rows of one key in one micro-batch
        for x in rows[value]:
            if x is not None and x == x:
                ema, visits = (1 - alpha) * ema + alpha * float(x), visits + 1
        state.update((ema, visits))
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "visits": [visits]})

    return events.groupBy(key).applyInPandasWithState(update, schema, "ema double, visits bigint", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; a window is final once the watermark has passed it, later rows are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return with_event_time(events, time, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, delay: str) -> DataFrame:
    return with_event_time(events, time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("rows"))


def without_repeats(events: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """First of rows that repeat ``keys`` within the watermark; state is dropped as the watermark moves on."""
    return with_event_time(events, time, delay).dropDuplicatesWithinWatermark(keys)
