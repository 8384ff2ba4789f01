"""Transcripts scored as they arrive: a file stream whose batches append to the table of cells.

Scoring looks at one row at a time, so the stream keeps no state and a restart from its checkpoint neither
drops nor repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import transcripts


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parsed transcripts of a folder, new files as they come."""
    return transcripts.parse(spark.readStream.schema(transcripts.RAW).option("wholetext", True).format("text").load(path))


def append_cells(stream: DataFrame, score, out: str, checkpoint: str) -> StreamingQuery:
    """Start writing ``score(batch)`` to ``out`` for each batch of what is there, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
