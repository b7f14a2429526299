"""What the training-data operators share: batches of whole texts, and tables kept in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python stop growing at this many bytes, so that a run of very long texts stays small in memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and by bytes; smaller bounds that are set already stay. Plans read them when they run,
    so they are left set."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is made only in local mode when the setting is absent."""
    if set_ := spark.conf.get("spark.checkpoint.dir", None):
        return set_
    sc = spark.sparkContext
    if own := sc.getCheckpointDir():
        return own
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="crawlmill-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its lineage ends there and lost executors cost nothing.

    Shuffle files that nothing refers to any more are let go; the table's own files go when the application ends."""
    spark = df.sparkSession
    to = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(to)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    gc.collect()
    spark._jvm.System.gc()  # Spark drops shuffles as their plans are collected
    made = spark.read.schema(schema).parquet(to)
    made.written_to = to
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing will read again: all that came of them must be written by now."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_forget: dict[str, Callable[[], None]] = {}
_running: list[str] = []


def begin(operator: str, forget: Callable[[], None]) -> None:
    """Called by a worker as it starts a task: what it remembers for other operators goes, and freed memory goes back to the system."""
    _forget[operator] = forget
    if _running != [operator]:
        for other, drop in _forget.items():
            if other != operator:
                drop()
        _running[:] = [operator]
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes."""
    at = batch.column(batch.schema.get_field_index(column))
    return at.cast(pa.large_binary() if pa.types.is_large_string(at.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut again where a batch is much larger than it should be."""
    for batch in batches:
        parts = min(batch.num_rows, max(1, -(-batch.nbytes // most)))
        step = max(1, -(-batch.num_rows // max(1, parts)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
