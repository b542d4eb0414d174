"""Writers of manifests, exported samples, vocabularies and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranking import RANGES, ranged_rank
from glyphmill.sources.readers import MANIFEST


def write_manifest(df: DataFrame, path: str, more: tuple[str, ...] = (), append: bool = False) -> None:
    """Manifest CSV with fixed columns; other columns are left out."""
    df.select(*[c for c in (*MANIFEST, *more)]).write.mode("append" if append else "overwrite").csv(path, header=True, escape='"', quoteAll=True)


def export_samples(df: DataFrame, path: str, key: str = "filename", buckets: int = RANGES) -> None:
    """Samples with an image, densely numbered from 1 in key order within (level, data_type, split).

    Rebuilding replaces only the partitions that are written. The number of samples is metadata of
    each partition (its largest index), not a row.
    """
    by = ["level", "data_type", "split"]
    good = df.filter(F.col("image").isNotNull())
    ranked = ranged_rank(good, by, [F.col(key)], rank="idx", buckets=buckets)
    ranked.select("idx", "image", "label", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def sample_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("level", "data_type", "split").agg(F.max("idx").alias("num_samples"))


def write_vocabulary(labels: DataFrame, path: str, label: str = "label") -> None:
    """One character per line in code-point order."""
    chars = labels.select(F.explode(F.split(label, "")).alias("char")).filter("char <> ''").distinct()
    chars.withColumn("code", F.ascii("char")).orderBy("code").select("char").coalesce(1).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, line: Column, *order: Column) -> None:
    """A text file in order (label lists of synthetic images and the like, which are one file by format)."""
    df.orderBy(*order).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_listings(lines: DataFrame, path: str, by: list[str], per_file: int = 1_000_000) -> None:
    """Text files of a `listing`: a folder for each group, in it an ordered run of files `part=0`, `part=1`, ... of `per_file` lines each.

    A task writes one file's lines, however long the group is; the files of a group in the order of their parts are its listing.
    """
    parts = lines.withColumn("part", F.floor((F.col("place") - 1) / per_file).cast("int"))
    tasks = lines.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = parts.repartition(int(tasks), *by, "part").sortWithinPartitions(*by, "part", "place")
    dealt.select(F.col("line").alias("value"), *by, "part").write.mode("overwrite").partitionBy(*by, "part").text(path)


def write_predictions(df: DataFrame, path: str, rates: list[str]) -> None:
    """Predictions CSV with rates as %.4f text."""
    cols = [F.format_string("%.4f", F.col(c)).alias(c) if c in rates else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def write_summary(df: DataFrame, path: str) -> None:
    """Nested summary rows as JSON lines, characters as they are."""
    df.write.mode("overwrite").json(path)


def disk_usage(files: DataFrame, by: str) -> DataFrame:
    """Bytes of files (a `read_images` table) per group."""
    return files.groupBy(by).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
