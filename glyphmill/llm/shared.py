"""Helpers that the operators share: stored intermediate tables, row hashes, byte tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Tables of more rows or bytes (as text) than this are never broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bounds of what a task holds of long texts while a table is stored: bytes of a batch for a Python worker, rows of a
#: batch that a Parquet reader decodes.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Stored tables: bytes that a writer keeps before it writes them out, rows between looks at a page's size.
_WRITER = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "10"}
_RUN = uuid.uuid4().hex
_ROOTS: dict[str, SparkSession] = {}
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for stored tables: inside spark.checkpoint.dir. A temporary folder only where that is unset and
    Spark runs in this one machine, as in tests; on a cluster executors would not share it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if "folder" not in _OWN:
            _OWN["folder"] = tempfile.mkdtemp(prefix="glyphmill-")
        base = _OWN["folder"]
    root = f"{base.rstrip('/')}/glyphmill-{_RUN}"
    _ROOTS[root] = spark
    return root


def apart(df: DataFrame) -> DataFrame:
    """`df` in a session of its own with BOUNDS over its caller's settings, which stay as they are.

    A setting that the application's configuration or the caller's session names is kept.
    """
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in {**BOUNDS, **spark.conf.getAll}.items():
        if spark.conf.isModifiable(key) or key in BOUNDS:
            own.conf.set(key, value)
    name = f"glyphmill_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives a lost executor.

    What a task holds of long texts while it writes is bounded by BOUNDS; the session's settings don't change.
    """
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:8]}"
    apart(df).write.options(**_WRITER).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (a stored table) with a broadcast hint if a count of rows, then of bytes, shows it to be small enough.

    Each task counts what it reads and hands on two numbers.
    """
    n = df.count()
    if n > rows:
        return df
    fixed = [f for f in df.schema.fields if not isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    long_ = [F.coalesce(_octets(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema.fields if f not in fixed]
    bytes_ = df.agg(F.sum(sum(long_, F.lit(8 * len(df.columns))).cast("long"))).first()[0] if n else 0
    return F.broadcast(df) if bytes_ <= size else df


def _octets(c: Column, kind: DataType) -> Column:
    return F.octet_length(c if isinstance(kind, (StringType, BinaryType)) else F.to_json(F.struct(c.alias("v"))))


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by `store` that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


@atexit.register
def _cleanup() -> None:
    for root, spark in _ROOTS.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # the JVM has already gone: nothing left to ask
            pass


def release() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc: its allocator decides by itself
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose Python workers, which Spark keeps for later tasks, give their memory back after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text leaves remainder 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
