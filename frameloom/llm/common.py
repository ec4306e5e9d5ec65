"""What the operators share: sessions, tables, columns, and the shared scratch folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from frameloom.jobs.session import importable
from frameloom.sources.scratch import discard, entries, exists, keep, materialize, remove, scratch_path, scratch_run, shared_root, stored  # noqa: F401

#: Rows of whole texts that go to a Python worker at once, where the session has Spark's default.
ARROW_ROWS = "1000"
#: Bytes of them, about, which bound long rows where the session has Spark's default of 64 MB.
ARROW_BYTES = "8m"


def job_session(spark: SparkSession) -> SparkSession:
    """For jobs to call before they read: keeps Arrow batches of texts small, unless the session was given a size of
    its own, and puts the library on the workers' path. Operators and readers leave sessions as they are."""
    for name, default, own in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
    return importable(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with derived ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches, which gives its memory back when its task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)  # what it held goes with it
        release()

    return released


def release() -> None:
    """For a Python worker to call when it has dropped large objects: what they took goes back to the system, where the
    allocators would keep it for the worker's next task, which may be another stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
