"""Reading batches of files as tables, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """files(path, name, length, modificationTime, content); unreadable files are skipped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return raw.withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """images(path, w, h, rgba) of static pictures; the reader's BGR, BGRA and grey rows become RGBA."""
    import numpy as np
    import pyarrow as pa

    raw = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                p = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                out = np.full((row["height"], row["width"], 4), 255, np.uint8)
                out[..., :3] = p[..., [2, 1, 0]] if p.shape[2] >= 3 else p[..., :1]
                if p.shape[2] == 4:
                    out[..., 3] = p[..., 3]
                made.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["path", "w", "h", "rgba"])

    return raw.mapInArrow(run, "path string, w int, h int, rgba binary")


def write_files(df: DataFrame, folder: str) -> None:
    """Results as Parquet with their contents, the form for clusters."""
    df.write.mode("overwrite").parquet(folder)
