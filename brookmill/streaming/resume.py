"""Scoring what arrives, chunk by chunk, each chunk written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brookmill.sources.manifest import append_once


def score_stream(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores JSON lines that appear in ``source``, all that are there now, and stops.

    A chunk's results go to a folder of its own, replaced if the chunk is run again after a failure, so every row is
    there once however often the query is restarted.
    """
    rows = spark.readStream.schema(schema).json(source)

    def write(chunk: DataFrame, number: int) -> None:
        append_once(score(chunk), out, f"{number:010d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
