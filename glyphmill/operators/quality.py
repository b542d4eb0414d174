"""Reasons to drop samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import is_allowed

#: Size limits of word and line images (fixed values).
WORD_LIMITS = {"min_width": 10, "min_height": 10, "max_height": 300, "min_aspect": 0.3, "max_aspect": 25.0}
LINE_LIMITS = {"min_width": 32, "min_height": 16, "max_height": 384, "max_width": 3000, "min_aspect": 1.0}

#: A rendered text is dropped where its image would be wider (fixed value).
RENDER_LIMITS = {"min_width": 1, "min_height": 1, "max_width": 2400}


def aspect(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0)


def size_reason(width: Column, height: Column, limits: dict[str, float]) -> Column:
    """First size limit that fails, null if none does."""
    ratio = aspect(width, height)
    checks = [
        ("width_small", "min_width", width, "<"), ("height_small", "min_height", height, "<"), ("height_large", "max_height", height, ">"),
        ("width_large", "max_width", width, ">"), ("aspect_low", "min_aspect", ratio, "<"), ("aspect_high", "max_aspect", ratio, ">"),
    ]
    out = F.lit(None).cast("string")
    for reason, name, value, side in reversed(checks):
        if name in limits:
            out = F.when(value < limits[name] if side == "<" else value > limits[name], reason).otherwise(out)
    return out


def drop_reason(label: Column, found: Column, width: Column, height: Column, limits: dict[str, float], ranges: list[tuple[int, int]] | None = None) -> Column:
    """First reason in fixed order: language, missing_file, corrupt, then sizes; null means keep.

    `found`: whether the image exists; a found image without width is corrupt. The cheap text check
    comes first, before anything that needs the image.
    """
    return (
        F.when(~is_allowed(label, ranges), "language").when(~found, "missing_file").when(width.isNull() | (width < 0), "corrupt").otherwise(size_reason(width, height, limits))
    )


def outlier_class(width: Column, height: Column) -> Column:
    """too_small, too_tall or narrow, first that fits; null for the rest."""
    return F.when((width < 10) | (height < 10), "too_small").when(height > 200, "too_tall").when(aspect(width, height) < 0.5, "narrow")


def quality_gate(df: DataFrame, bad: Column, order: list[Column], rows: int = 100, most: float = 0.05) -> DataFrame:
    """One row: checked, bad_share, passed, over the first `rows` rows in order."""
    head = df.orderBy(*order).limit(rows)
    return head.agg(F.count(F.lit(1)).alias("checked"), F.avg(bad.cast("double")).alias("bad_share")).withColumn("passed", F.coalesce(F.col("bad_share") <= most, F.lit(True)))
