"""The folder that driver and executors share: what jobs write on their way, and when it goes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark's Hadoop client knows them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = file_system(spark, path)
    return fs.exists(there)


def entries(spark: SparkSession, path: str) -> list[str]:
    """The paths in a folder, none if it does not exist."""
    fs, there = file_system(spark, path)
    return [x.getPath().toString() for x in fs.listStatus(there)] if fs.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, there = file_system(spark, path)
    fs.delete(there, True)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset and all tasks run in this process, as in tests, a temporary folder is made and removed at exit.
    On a cluster executors would write to their own disks, so there it must be set.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes with all it holds when the application ends.

    Hadoop only marks what exists, so the folder is made first. An application that is killed leaves its folder, which
    has its id as name, behind.
    """
    path = f"{shared_root(spark)}/frameloom/run-{spark.sparkContext.applicationId}"
    fs, there = file_system(spark, path)
    if not fs.exists(there):
        fs.mkdirs(there)
        fs.deleteOnExit(there)
    return path


#: Folders of the runs that are open, the innermost last.
_RUNS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of the innermost run, or in the application's."""
    return f"{_RUNS[-1] if _RUNS else run_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession, name: str) -> Iterator[None]:
    """What is materialized inside goes when the run ends. What is to outlast it is materialized by keep()."""
    path = scratch_path(spark, name)
    _RUNS.append(path)
    try:
        yield
    finally:
        _RUNS.remove(path)
        remove(spark, path)


#: Where tables that were written here stand.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written to a path and read back."""
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, before its run ends: for large tables that nothing written later reads."""
    remove(df.sparkSession, _WRITTEN.pop(df))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A lost executor then costs its running tasks only, and later passes read the written rows. Inside a run they go
    with it, else when the application ends.
    """
    return stored(df, scratch_path(df.sparkSession, name))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Materialize outside of any run; the rows go when the application ends."""
    return stored(df, f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
