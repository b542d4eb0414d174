"""Joins of values to the intervals that hold them, as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(width: Column) -> Column:
    """Power of two that is the least not below a width (at least 2**-40)."""
    return F.ceil(F.log2(F.greatest(width, F.lit(2.0**-40)))).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """`points` joined to all rows of `intervals` (of equal `by`) with low <= value < high.

    An interval belongs to the level of its width, the power of two just above it, and there lies in two cells at most; a point
    is looked up in one cell of each level that occurs, of which there are few however many intervals there are. So both sides meet
    by (by, level, cell), never as a nested loop, and rows made follow the matches, but for intervals of a
    cell that the point is outside of. Null ends or values and empty intervals match nothing; infinite ends are not allowed. Values are
    compared as doubles to find cells and as they are in the end. Columns of both sides need different names, `by` aside.
    """
    lo, hi, at = F.col(low).cast("double"), F.col(high).cast("double"), F.col(value).cast("double")
    cut = intervals.filter(F.col(low) < F.col(high)).withColumn("_level", _level(hi - lo))
    cut = cut.withColumn("_cell", F.explode(F.sequence(_cell(lo, F.col("_level")), _cell(hi, F.col("_level")))))
    levels = cut.select("_level").distinct().agg(F.coalesce(F.sort_array(F.collect_list("_level")), F.array().cast("array<int>")).alias("l")).scalar()  # one row a level
    asked = points.filter(F.col(value).isNotNull()).withColumn("_level", F.explode(levels)).withColumn("_cell", _cell(at, F.col("_level")))
    met = asked.join(cut, [*by, "_level", "_cell"]).filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))
    return met.drop("_level", "_cell")
