"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.retrieval import spread

#: Words are runs of anything but ASCII white space (Java regex).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where that is unset and all runs on this machine (tests) a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-checkpoint-"))
    return sc.getCheckpointDir()


#: Rows that go to a Python worker at a time where they hold whole texts, and bytes: a batch ends with the row that fills it.
TEXTS, BATCH_BYTES = 500, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int = TEXTS, size: int = BATCH_BYTES):
    """What is executed meanwhile goes to Python workers in batches of at most so many rows and bytes; the session's own bounds come back."""
    before = {key: spark.conf.get(key) for key in (_ROWS, _BYTES)}
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession, rows: int = TEXTS, size: int = BATCH_BYTES) -> None:
    """From now on at most so many rows and bytes go to a Python worker at a time: for what is returned before it is executed."""
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, str(size))


def checkpoint(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: what is downstream never recomputes it. `batch` bounds the rows of an Arrow batch meanwhile, and its bytes."""
    shared_folder(df.sparkSession)
    with batches(df.sparkSession, batch) if batch else contextlib.nullcontext():
        return df.checkpoint()


def write_shared(df: DataFrame) -> str:
    """As checkpoint(), as a Parquet table; for wide rows. Gives its path."""
    path = f"{shared_folder(df.sparkSession)}/claimloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove what write_shared() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What to forget when another operator's tasks come to this Python worker.
_CACHES: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def forgets(name: str, clear: Callable[[], None]) -> None:
    """Register how to clear the caches that operator `name` keeps between tasks."""
    _CACHES[name] = clear


@contextlib.contextmanager
def working(name: str):
    """Around a task's Python code: caches of other operators go first, and freed memory is given back at the end."""
    if _OWNER[0] != name:
        for other, clear in _CACHES.items():
            if other != name:
                clear()
        _OWNER[0] = name
        give_back()
    try:
        yield
    finally:
        give_back()


def give_back() -> None:
    """Return unused memory of Arrow and, where there is a glibc, of the heap to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores if it lies in fewer pieces than there are."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of the text, null read as empty."""
    return text_of(column).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
