"""Run logs as a stream: new files are parsed once and appended; restarts go on where they stopped."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from blockloom.sources import logs


def ingest(spark: SparkSession, source: str, target: str, state: str) -> StreamingQuery:
    """Appends the result rows of new log files in ``source`` to Parquet in ``target``; ``state`` remembers what is done."""
    lines = spark.readStream.schema("value string").text(source)
    rows = logs.benchmark_rows(lines)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
