"""Scoring of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrace.plans.model import Model


def score_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scores of a stream appended to Parquet files below path. Scoring keeps no state, so every micro-batch is a projection (a broadcast or sorted join for encoded features)."""
    writer = model.transform(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
