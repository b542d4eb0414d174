"""A table in front of a slow source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.readers import try_table


def read_through(wanted: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], key: str, schema: str) -> DataFrame:
    """Rows of the cache at `path` for the keys of `wanted`; what it lacks goes through `fetch` and is appended first.

    `fetch` gets a table of distinct keys, never null and none of them in the cache, and gives the rows (`schema`, with the key) of those the source has: any
    plan, such as a mapInPandas that asks a service. One job fetches and appends; Spark's committer shows its files when all of them are done,
    and what a failed job left is fetched again by the next call, and only that. Keys that the source doesn't have are
    asked for each time. Repeated keys count once; an empty `wanted` reads nothing from the source.
    """
    spark = wanted.sparkSession
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    known = try_table(spark, path)
    lacking = keys if known is None else keys.join(known.select(key), key, "left_anti")
    names = spark.createDataFrame([], schema).columns
    if not lacking.isEmpty():
        fetch(lacking).select(*names).write.mode("append").parquet(path)
    return cached(spark, path, schema).join(keys, key, "left_semi").select(*names)


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole cache; an empty table if nothing was ever fetched."""
    known = try_table(spark, path)
    return spark.createDataFrame([], schema) if known is None else known
