"""Sessions of streams, alike on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, stream: str, time: str, gap: str, late: str) -> DataFrame:
    """(stream, start, end, rows): stretches without a pause of gap, closed once the watermark passes;
    works on batches and on streams. Rows later than `late` are dropped on streams."""
    windowed = rows.withWatermark(time, late) if rows.isStreaming else rows
    return (
        windowed.groupBy(stream, F.session_window(time, gap).alias("w"))
        .agg(F.count("*").alias("rows"))
        .select(stream, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")
    )
