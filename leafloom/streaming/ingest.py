"""Beyond the inventory: documents that arrive as a stream are read by the same row-local folds.

A document is whole in its row, so no state is kept between rows; repeated deliveries are dropped within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import folds


def ingest_stream(docs: DataFrame, *, key: str = "doc_id", time: str = "run_at", late: str = "1 day") -> DataFrame:
    """docs(doc_id, text, run_at) as a stream -> ingested documents; a key that comes again within ``late`` is dropped."""
    once = docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return folds.ingest(once)


def start(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the stream to Parquet, exactly once."""
    return ingest_stream(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
