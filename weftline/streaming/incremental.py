"""Episodes and windows kept up to date from a stream. An extension: the batch operators have the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_events(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windows(stream: DataFrame, at: str, by: str, value: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of each tumbling window and group."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; Parquet parts are committed once."""
    q = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
