"""Detected boxes to reading-order lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confident(df: DataFrame, least: float = 0.3, conf: str = "conf") -> DataFrame:
    return df.filter(F.col(conf) >= least)


def to_pixels(share: Column, size: Column) -> Column:
    """Relative coordinate to pixels, cut to an integer."""
    return (share * size).cast("int")


def polygon_box(polygon: Column) -> Column:
    """struct(x1, y1, x2, y2) around an array x, y, x, y, ..."""
    xs, ys = F.filter(polygon, lambda _, i: i % 2 == 0), F.filter(polygon, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def fit_inside(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """struct(scale, width, height) of an image scaled to fit, each side at least 1."""
    scale = F.least(F.lit(to_height) / height, F.lit(to_width) / width)
    side = lambda n: F.greatest(F.lit(1), (n * scale).cast("int"))
    return F.struct(scale.alias("scale"), side(width).alias("width"), side(height).alias("height"))


def line_clusters(df: DataFrame, page: Sequence[str], y1: str = "y1", y2: str = "y2", key: Sequence[str] = ("box_id",), floor: float = 10.0, share: float = 0.5) -> DataFrame:
    """cluster: lines of boxes by their vertical centers, a new line where the gap to the center above is
    over share * max(median height, floor) of the page."""
    center, height = (F.col(y1) + F.col(y2)) / 2, F.col(y2) - F.col(y1)
    eps = df.groupBy(*page).agg((F.greatest(F.median(height), F.lit(floor)) * share).alias("_eps"))
    out = df.withColumn("_y", center).join(eps, list(page))
    w = W.partitionBy(*page).orderBy("_y", *key)
    gap = F.coalesce(F.col("_y") - F.lag("_y").over(w) > F.col("_eps"), F.lit(False)).cast("int")
    out = out.withColumn("_new", gap)
    return out.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new", "_eps")


def reading_order(df: DataFrame, page: Sequence[str], x1: str = "x1", key: Sequence[str] = ("box_id",)) -> DataFrame:
    """line_no and box_no (from 1) of clustered boxes: lines by mean center, boxes from the left."""
    mean = F.avg("_y").over(W.partitionBy(*page, "cluster"))
    out = df.withColumn("_line_y", mean)
    out = out.withColumn("line_no", F.dense_rank().over(W.partitionBy(*page).orderBy("_line_y", "cluster")))
    return out.withColumn("box_no", F.row_number().over(W.partitionBy(*page, "cluster").orderBy(x1, *key))).drop("_line_y")


def line_boxes(df: DataFrame, page: Sequence[str]) -> DataFrame:
    """Box around each line and the number of its boxes."""
    return df.groupBy(*page, "line_no").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("boxes"))


def crop_boxes(df: DataFrame, width: Column, height: Column, pad: int = 4, least: int = 8) -> DataFrame:
    """Boxes padded, clamped to the page, and dropped where a side is then under `least`."""
    out = df.withColumns({
        "x1": F.greatest(F.lit(0), F.col("x1") - pad), "y1": F.greatest(F.lit(0), F.col("y1") - pad),
        "x2": F.least(width, F.col("x2") + pad), "y2": F.least(height, F.col("y2") + pad),
    })
    return out.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def page_text(df: DataFrame, page: Sequence[str], text: str) -> DataFrame:
    """Texts of a page's lines joined by newlines in line order."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", text)))
    return df.groupBy(*page).agg(F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("page_text"))


def skew_angle(df: DataFrame, page: Sequence[str], most: float = 15.0, ignore: float = 0.5) -> DataFrame:
    """Median angle of near-horizontal segments (dx, dy), 0 where it is too small to matter."""
    angle = F.degrees(F.atan2("dy", "dx"))
    found = df.withColumn("_a", angle).filter(F.abs("_a") < most).groupBy(*page).agg(F.median("_a").alias("angle"))
    return found.withColumn("angle", F.when(F.abs("angle") < ignore, 0.0).otherwise(F.col("angle")))
