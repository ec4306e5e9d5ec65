"""Reversible permutation of pixels along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.gilbert import gilbert_curve, shift

C = F.col
#: Rows of a curve (16 bytes each) that may be broadcast.
CURVE_ROWS = 1 << 18


def curves(sizes: DataFrame) -> DataFrame:
    """curve(w, h, idx, x, y): once for each distinct size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = gilbert_curve(w, h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), w, np.int32)), pa.array(np.full(len(c), h, np.int32)), pa.array(np.arange(len(c), dtype=np.int64)), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1]))], ["w", "h", "idx", "x", "y"])

    return sizes.select(C("w").cast("int").alias("w"), C("h").cast("int").alias("h")).distinct().mapInArrow(run, "w int, h int, idx long, x int, y int")


def scramble_pixels(pixels: DataFrame, curve: DataFrame, w: int, h: int, back: bool = False) -> DataFrame:
    """Relational form: the pixel at curve[i] moves to curve[(i + shift) mod n]; `back` undoes it.

    The curve has w * h rows: up to CURVE_ROWS it is broadcast, a larger one is joined by shuffling both sides.
    """
    n = w * h
    by = -shift(n) if back else shift(n)
    one = curve.filter((C("w") == w) & (C("h") == h)).select("idx", "x", "y")
    one = F.broadcast(one) if n <= CURVE_ROWS else one.hint("shuffle_hash")
    moved = pixels.join(one, ["x", "y"]).withColumn("idx", F.pmod(C("idx") + by, F.lit(n))).drop("x", "y")
    return moved.join(one, "idx").select("image_id", "x", "y", "r", "g", "b", "a")


def scramble(images: DataFrame, times: int = 1, back: bool = False) -> DataFrame:
    """Block form (the default): one gather for each image row, no shuffle. A task keeps one curve for each size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                w, h = row["w"], row["h"]
                if (w, h) not in kept:
                    if len(kept) > 8:
                        kept.clear()
                    c = gilbert_curve(w, h)
                    kept[w, h] = c[:, 1].astype(np.int64) * w + c[:, 0]
                at = kept[w, h]
                to = np.roll(at, -(shift(len(at)) * times) % max(1, len(at)))
                p = np.frombuffer(row["rgba"], "<u4")
                q = np.empty_like(p)
                q[at if back else to] = p[to if back else at]
                made.append(q.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], batch.schema.names)

    shaped = images.select(C("image_id").cast("long").alias("image_id"), C("w").cast("int").alias("w"), C("h").cast("int").alias("h"), "rgba")
    return shaped.mapInArrow(run, shaped.schema)
