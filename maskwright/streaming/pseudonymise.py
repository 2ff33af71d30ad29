"""Pseudonymising a stream. Replacement keeps no state, so a stream takes the same expressions as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.replace import apply_pairs


def pseudonymise_stream(stream: DataFrame, pairs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The stream with its columns replaced; the map is read once, when the query starts."""
    return apply_pairs(stream, pairs, columns)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived, once each, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
