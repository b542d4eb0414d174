"""Operators on ordered rows: training logs, running values, matching to earlier lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_write(df: DataFrame, key: Sequence[str], order: str, first: str = "first_order") -> DataFrame:
    """The last row of each key, and the place at which the key first came up."""
    group = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_r"), F.min(order).alias(first))
    return group.select(*key, "_r.*", first)


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def forward_fill(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Last non-null value up to and including each row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def asof_backward(df: DataFrame, is_left: Column, is_right: Column, payload: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of one kind, each with the payload of the latest preceding row of the other kind.

    Both kinds are rows of one ordered table, so one pass of a window does it; without a preceding
    row the payload is null.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(is_right, F.struct(*payload)), ignorenulls=True).over(w)
    out = df.withColumn("_found", found).filter(is_left)
    return out.select(*df.columns, *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in payload]).drop("_found")


def rolling_mean(value: Column, by: Sequence[str], order: Sequence[str], rows: int) -> Column:
    """Mean of the last `rows` values, nulls left out, fewer at the start."""
    return F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0))


def running_best(df: DataFrame, value: str, safe: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """best_before (least safe value of earlier rows) and is_best (safe and less than that)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("best_before", F.min(F.when(safe, F.col(value))).over(w))
    return df.withColumn("is_best", safe & (F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))))


def early_stop(df: DataFrame, regressed: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows up to and including the first that regressed, with stopped marking that one."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("stopped", regressed)
    past = F.coalesce(F.max(F.col("stopped").cast("int")).over(before), F.lit(0))
    return out.withColumn("_past", past).filter("_past = 0").drop("_past")


def epoch_runtime(df: DataFrame, ts: str, epoch: str, restarted: str, by: Sequence[str], most_seconds: int = 6 * 3600) -> DataFrame:
    """runtime: seconds since the epoch before, where that is the preceding number, was not restarted and the gap is in (0, 6 h)."""
    w = W.partitionBy(*by).orderBy(epoch)
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    ok = (F.lag(epoch).over(w) == F.col(epoch) - 1) & ~F.lag(restarted).over(w) & (gap > 0) & (gap < most_seconds)
    return df.withColumn("runtime", F.when(ok, gap))


def change_points(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose value differs from the row before (the first row is none)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def any_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of which at least one of the columns has a value."""
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
