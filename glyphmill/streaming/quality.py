"""Streaming counters over arriving samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_arrivals(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """kind, start, n, mean of tumbling windows; rows later than the watermark are left out."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = out.groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(kind, F.col("window.start").alias("start"), "n", "mean")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run what is there now to the end into an in-memory table."""
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def append_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there now to Parquet, exactly once per checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
