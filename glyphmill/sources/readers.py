"""Readers of the layouts in which labelled samples come. All return lazy tables.

Label maps and manifests have the seven string columns of MANIFEST; order is never implied, so readers
that need it carry a line number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions.text import image_name, normalize_label

MANIFEST = ["filename", "label", "source", "level", "data_type", "writer_id", "pre_split"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads it from."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, a scan, dealt anew where fewer of its splits hold rows than there are cores (a file of one row group
    is one task, however large). Tables of many splits, which are all large ones, are left as they are.

    With `rows`, what a task gets does not grow with the table: a scan with a split of over twice as many rows
    is dealt into tasks of about so many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        busy, most, n = sizes.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
        return df if not n or busy >= cores and most <= 2 * rows else df.repartition(max(2 * cores, -(-n // rows)))
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    busy = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df if busy >= cores else df.repartition(2 * cores)


def read_manifest(spark: SparkSession, path: str, more: Sequence[str] = ()) -> DataFrame:
    """Manifest CSV (all strings, doubled quotes, line breaks in fields); a missing file is an empty table."""
    schema = ", ".join(f"{c} string" for c in [*MANIFEST, *more])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_first(spark: SparkSession, paths: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """The first manifest that exists (filtered, split, master); empty if none does."""
    return read_manifest(spark, next((p for p in paths if exists(spark, p)), paths[-1]), more)


def read_label_map(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """filename, label of JSON objects {file: label}; of alternative paths the first that exists."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], "filename string, label string")
    text = spark.read.text(found, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "label"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0), value of the lines of text files, which are read split by split.

    Row ids that rise within a split are turned into line numbers by two sums over the splits alone: the lines of
    earlier splits of the file, less the split's first row id. No line is shuffled, and a file is as many tasks as
    it has splits. Lines end at LF, CR or both; a file's last line end opens no further line.
    """
    found = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    text = spark.read.text(path).select("value", found.alias("split"), F.monotonically_increasing_id().alias("row"))
    splits = text.groupBy("split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).select("split.*", "first", "n")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a file's splits
    splits = splits.select(F.struct("path", "start").alias("split"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return text.join(splits, "split").select(F.col("split.path").alias("path"), (F.col("row") + F.col("shift")).alias("line_no"), "value")


def read_label_lines(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    """filename, label of `file<TAB>label` lines: split at the first tab, both stripped, lines without tab skipped.

    Of repeated files the last line counts, or all do.
    """
    lines = numbered_lines(spark, path).filter(F.contains("value", F.lit("\t")))
    parts = F.split("value", "\t", 2)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    out = lines.select("path", "line_no", strip(parts[0]).alias("filename"), strip(parts[1]).alias("label"))
    if not last_wins:
        return out.select("filename", "label")
    return out.groupBy("filename").agg(F.max_by("label", F.struct("path", "line_no")).alias("label"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """value of non-blank lines, stripped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value")).filter("value <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, extract of article responses ({"query": {"pages": {id: {...}}}}); the id -1 means missing."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "struct<query:struct<pages:map<string,struct<title:string,extract:string>>>>")
    pages = text.select(F.explode(parsed["query"]["pages"]).alias("id", "page")).filter("id <> '-1'")
    return pages.select("page.title", "page.extract").filter("extract IS NOT NULL")


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """filename, path, bytes, width, height of image files below a folder; sizes from PNG headers, null if corrupt."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    size = png_size(F.col("content"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", F.col("length").alias("bytes"), size["width"].alias("width"), size["height"].alias("height"))


def read_fonts(spark: SparkSession, path: str) -> DataFrame:
    """font_no (from 0, in order of names), name, path of the .ttf files of a folder; no rows if there are none or no folder."""
    if not exists(spark, path):
        return spark.createDataFrame([], "font_no long, name string, path string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttf").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return files.select((F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("font_no"), "name", "path")  # a folder's file names


def png_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, without decoding it; nulls for anything else."""
    ok = (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A")
    number = lambda at: F.when(ok, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return F.struct(number(17).alias("width"), number(21).alias("height"))


def writer_of(path: Column) -> Column:
    """Name of the all-digit folder that holds a file, null if it is none."""
    return F.nullif(F.regexp_extract(path, r"/(\d+)/[^/]+$", 1), F.lit(""))


def read_samples(spark: SparkSession, path: str, index: int | None = None) -> DataFrame:
    """Exported samples (level, data_type, split, idx, image, label), or the one at an index of each partition."""
    df = spark.read.parquet(path)
    return df if index is None else df.filter(F.col("idx") == index)


#: Patterns of training logs (fixed values): phase, epoch lines of the three stages, time stamp, evaluations.
PHASE = r"(?i)phase[_\-\s]*(1[a-c])"
STAGE_1 = r"(?i)\[Stage1\]\s*Epoch\s*(\d+)\s*done\s*\|\s*avg_loss=([0-9.]+)\s*\|\s*time=(\d+)s"
STAGE_2A = r"(?i)\[Stage2a\]\s*Epoch\s*(\d+)\s*\|\s*avg_(?:loss|CE)=([0-9.]+)"
STAGE_2B = r"(?i)\[Stage2b\]\s*Epoch\s*(\d+)\s*\|\s*avg_CE=([0-9.]+)"
STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
PRINTED = r"(?i)printed.*?CER=([0-9.]+).*?WER=([0-9.]+)"
HANDWRITTEN = r"(?i)(?:handwritten|hw).*?CER=([0-9.]+).*?WER=([0-9.]+)"


def told_lines(lines: DataFrame) -> DataFrame:
    """What each line (path, line_no, value) of a training log tells: mark, stage, epoch, loss, runtime, ts, and the rates printed and hw; lines
    that no pattern fits are left out. A line belongs to one stage, the last that fits; numbers that are none are null."""
    part = lambda p, i: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    number = lambda p, i, kind: part(p, i).try_cast(kind)
    pick = lambda i, kind: F.coalesce(number(STAGE_2B, i, kind), number(STAGE_2A, i, kind), number(STAGE_1, i, kind))
    fits = lambda p: F.col("value").rlike(p)
    stage = F.when(fits(STAGE_2B), "stage2b").when(fits(STAGE_2A), "stage2a").when(fits(STAGE_1), "stage1")
    both = lambda p: F.when(fits(p), F.struct(number(p, 1, "double").alias("cer"), number(p, 2, "double").alias("wer")))
    return lines.select(
        "path", "line_no", F.lower(part(PHASE, 1)).alias("mark"), stage.alias("stage"), pick(1, "int").alias("epoch"), pick(2, "double").alias("loss"),
        F.when(stage == "stage1", number(STAGE_1, 3, "int")).alias("runtime"), F.when(stage != "stage1", F.try_to_timestamp(part(STAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"),
        both(PRINTED).alias("printed"), both(HANDWRITTEN).alias("hw"),
    ).filter("mark IS NOT NULL OR stage IS NOT NULL OR printed IS NOT NULL OR hw IS NOT NULL")


def parse_log(lines: DataFrame) -> DataFrame:
    """Epoch table of training logs given as path, line_no, value: path, stage, phase, epoch, loss, runtime, ts,
    printed_cer, printed_wer, hw_cer, hw_wer, restarted, first_line.

    One ordered pass over the lines of each log that any pattern fits; the others go before anything is shuffled. Phases are filled forward and count for the first stage; an
    evaluation goes to the epoch line before it, or to the one on its own line. An epoch that is run
    again starts over: its last run counts, evaluations of earlier ones are dropped. restarted: an epoch of stage 2a
    that was run again after a run with a time stamp; ts is the last stamp of any of its runs.
    """
    rows = told_lines(lines)
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)  # the telling lines of one log
    rows = rows.withColumn("mark", F.last("mark", True).over(w)).withColumn("run", F.count("stage").over(w)).filter("run > 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    phase = F.when(F.col("stage") == "stage1", F.col("mark")).when(F.col("stage").isNotNull(), F.substring("stage", 6, 2))
    runs = rows.withColumn("phase", phase).groupBy("path", "run").agg(
        *[F.first(c, True).alias(c) for c in ("stage", "phase", "epoch", "loss", "runtime", "ts")], last("printed"), last("hw"), F.min("line_no").alias("line_no")
    )
    of_run = lambda c: F.max_by(c, "run")
    stamped = F.min(F.when(F.col("ts").isNotNull(), F.col("run")))
    return runs.groupBy("path", "stage", "phase", "epoch").agg(
        of_run("loss").alias("loss"), of_run("runtime").alias("runtime"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("run"))).alias("ts"),
        *[of_run(f"{kind}.{rate}").alias(f"{kind}_{rate}") for kind in ("printed", "hw") for rate in ("cer", "wer")],
        F.coalesce((F.col("stage") == "stage2a") & (F.max("run") > stamped), F.lit(False)).alias("restarted"), F.min("line_no").alias("first_line"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """`parse_log` of text files."""
    return parse_log(numbered_lines(spark, path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """path, name, value of the numbers in metrics files, each one JSON object; nested names are joined by dots."""
    number = "map<string,string>"
    level = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", number)).alias("name", "value"))
    deep = level.filter("value LIKE '{%'").select("path", "name", F.explode(F.from_json("value", number)).alias("inner", "value"))
    deep = deep.select("path", F.concat_ws(".", "name", "inner").alias("name"), "value")
    return level.filter("value NOT LIKE '{%'").unionAll(deep).select("path", "name", F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL")


@dataclass
class Dataset:
    """How one labelled dataset is laid out: a label table, image files, and the constants of its rows."""

    name: str
    labels: DataFrame
    images: DataFrame
    level: str
    data_type: str
    pre_split: str
    prefix: str | None = None
    writer: Column | None = None
    rename: tuple[str, str] | None = field(default=None)


def manifest_rows(d: Dataset) -> DataFrame:
    """Manifest rows of a dataset: labels normalised, rows without label or image dropped."""
    labels = d.labels.select("filename", normalize_label(F.col("label")).alias("label")).filter("label IS NOT NULL")
    if d.rename:
        labels = labels.withColumn("filename", F.replace("filename", F.lit(d.rename[0]), F.lit(d.rename[1])))
    rows = labels.join(d.images.select("filename"), "filename", "left_semi")
    writer = d.writer if d.writer is not None else F.lit("")
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    rows = rows.withColumn("_stem", stem).withColumn("writer_id", writer)
    return rows.select(
        image_name(F.col("filename"), d.prefix).alias("filename"), "label", F.lit(d.name).alias("source"), F.lit(d.level).alias("level"),
        F.lit(d.data_type).alias("data_type"), F.col("writer_id").cast("string").alias("writer_id"), F.lit(d.pre_split).alias("pre_split"),
    )


def union_datasets(datasets: Sequence[Dataset]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(manifest_rows, datasets))


def try_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
