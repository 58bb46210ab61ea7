"""Cleaning streams. It is a projection without state, so batch and stream share it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.clean import clean


def clean_stream(source: DataFrame, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Clean what is there now and append it to Parquet files, exactly once. Columns
    are assigned by name, since a stream can't be sampled; `cleaners` adds to that."""
    if not source.isStreaming:
        raise TypeError("clean_stream() takes a streaming DataFrame")
    out = clean(source, **options)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
