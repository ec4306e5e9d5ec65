"""Threshold decoding: luma histograms, windows, and the filling of what falls outside."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.pixels import clamp, half_up, luma, store, to_known_images, with_pixels
from frameloom.sources.scratch import keep, materialize, scratch_run

C = F.col
#: Weights of the neighbours by squared distance (fixed values).
WEIGHTS = {1: 0.6065, 2: 0.3679, 4: 0.1353, 5: 0.0821, 8: 0.0183}
OFFSETS = [(dx, dy, WEIGHTS[dx * dx + dy * dy]) for dy in range(-2, 3) for dx in range(-2, 3) if dx or dy]


def luma_histogram(pixels: DataFrame) -> DataFrame:
    """hist(image_id, luma, n): at most 256 rows an image leave a task."""
    return pixels.groupBy("image_id", luma(C("r"), C("g"), C("b"), stored=False).alias("luma")).agg(F.count("*").alias("n"))


def auto_window(hist: DataFrame) -> DataFrame:
    """(image_id, low, high): from 0 to the luma at which half of the pixels are reached."""
    w = Window.partitionBy("image_id")
    seen = hist.withColumns({"cum": F.sum("n").over(w.orderBy("luma")), "total": F.sum("n").over(w)})
    return seen.filter(C("cum") * 2 >= C("total")).groupBy("image_id").agg(F.min("luma").alias("high")).select("image_id", F.lit(0).alias("low"), "high")


def window_decode(pixels: DataFrame, fill: str = "ltavg") -> DataFrame:
    """Stretch what lies in the window (columns low, high, contrast) to all tones; the rest is filled and flagged."""
    v = luma(C("r"), C("g"), C("b"))
    inside = (C("high") > C("low")) & (v >= C("low")) & (v <= C("high"))
    empty = {"black": (0, 255), "white": (255, 255), "transparent": (0, 0), "ltavg": (0, 255)}[fill]

    def tone(c: str) -> Column:
        s = clamp(half_up((C(c) - C("low")) * 255.0 / F.nullif(C("high") - C("low"), F.lit(0))))
        s = F.when(C("contrast") != 0, clamp(half_up((s - 128) * C("contrast") / 50.0 + 128))).otherwise(s)
        return F.when(inside, s).otherwise(empty[0]).cast("int").alias(c)

    return pixels.select("image_id", "x", "y", *(tone(c) for c in "rgb"), F.when(inside, C("a")).otherwise(empty[1]).cast("int").alias("a"), (~inside).alias("is_fill"))


def diffuse_round(decoded: DataFrame) -> DataFrame:
    """One synchronous round: an unfilled pixel becomes the weighted mean of the known ones among its 24 neighbours.

    Known pixels tell their neighbours and unfilled ones ask at their place; both are summed by place before the shuffle.
    Both sides of the join are pixels, which Spark takes for as small as the packed vectors they are made of, so it
    is told to merge and not to broadcast.
    """
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in OFFSETS))
    here = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(None).cast("double").alias("k")))
    told = decoded.filter(C("image_id").isNotNull()).select("image_id", "x", "y", *"rgba", F.explode(F.when(C("is_fill"), here).when(~C("is_fill"), near)).alias("o"))
    mean = told.groupBy("image_id", (C("x") + C("o.dx")).alias("x"), (C("y") + C("o.dy")).alias("y")).agg(
        F.max(C("o.k").isNull()).alias("asked"), F.sum("o.k").alias("k"), *(F.sum(C(c) * C("o.k")).alias(c) for c in "rgba"))
    mean = mean.filter("asked AND k IS NOT NULL").select("image_id", "x", "y", *(store(F.round(C(c) / C("k"), 6)).alias(f"m{c}") for c in "rgba"))
    got = decoded.join(mean.hint("merge"), ["image_id", "x", "y"], "left")
    return got.select("image_id", "x", "y", *(F.coalesce(f"m{c}", c).alias(c) for c in "rgba"), (C("is_fill") & C("mr").isNull()).alias("is_fill"))


def diffuse_block(rgba: np.ndarray, known: np.ndarray, rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same on an image block, `rounds` rounds (None: any number), until nothing is left or nothing changes."""
    h, w = known.shape
    rgba, known = rgba.astype(np.float64), known.copy()
    for _ in count() if rounds is None else range(rounds):
        if known.all():
            break
        weight, total = np.zeros((h, w)), np.zeros((h, w, 4))
        padded, there = np.pad(rgba, ((2, 2), (2, 2), (0, 0))), np.pad(known, 2)
        for dx, dy, k in OFFSETS:
            m = there[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] * k
            weight += m
            total += padded[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] * m[..., None]
        new = ~known & (weight > 0)
        if not new.any():
            break
        rgba[new] = np.rint(np.round(total[new] / weight[new][:, None], 6))
        known |= new
    return rgba.astype(np.uint8), known


def _nearer(open_: DataFrame, known: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a) of the open pixels near known ones: their weighted means. The smaller side is spread over its neighbours."""
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in OFFSETS))
    if open_.count() <= known.count():
        asked = open_.select("image_id", C("x").alias("tx"), C("y").alias("ty"), F.explode(near).alias("o"))
        asked = asked.select("image_id", "tx", "ty", (C("tx") + C("o.dx")).alias("x"), (C("ty") + C("o.dy")).alias("y"), C("o.k").alias("k"))
        met = asked.join(known, ["image_id", "x", "y"])
    else:
        told = known.select("image_id", *"rgba", (C("x")).alias("kx"), C("y").alias("ky"), F.explode(near).alias("o"))
        told = told.select("image_id", *"rgba", (C("kx") + C("o.dx")).alias("tx"), (C("ky") + C("o.dy")).alias("ty"), C("o.k").alias("k"))
        met = told.join(open_.select("image_id", C("x").alias("tx"), C("y").alias("ty")), ["image_id", "tx", "ty"])
    return met.groupBy("image_id", C("tx").alias("x"), C("ty").alias("y")).agg(*(store(F.round(F.sum(C(c) * C("k")) / F.sum("k"), 6)).alias(c) for c in "rgba"))


def diffuse_pixels(decoded: DataFrame, rounds: int | None = None) -> DataFrame:
    """diffuse_fill() on pixels, `rounds` rounds or until nothing changes: no task holds an image.

    A pixel is filled in the round after the first one near it, so only what the last round filled is known to the next:
    each round joins that frontier with the pixels still open. Both are written between rounds, which are as many as a
    hole is wide, by four pixels; the block form is for wide holes in small images.
    """
    spark = decoded.sparkSession
    with scratch_run(spark, "diffusion"):
        now = materialize(decoded.select("image_id", "x", "y", *(C(c).cast("int").alias(c) for c in "rgba"), "is_fill"), "decoded")
        front, left = now.filter("NOT is_fill").drop("is_fill"), now.filter("is_fill").drop("is_fill")
        done = [front]
        for _ in count() if rounds is None else range(rounds):
            front = materialize(_nearer(left, front), "filled")
            if front.isEmpty():
                break
            done.append(front)
            left = materialize(left.join(front, ["image_id", "x", "y"], "left_anti"), "open")
            if left.isEmpty():
                break
        flagged = [f.select("image_id", "x", "y", *"rgba", F.lit(False).alias("is_fill")) for f in done]
        return keep(reduce(DataFrame.unionByName, [*flagged, left.select("image_id", "x", "y", *"rgba", F.lit(True).alias("is_fill"))]), "diffused")


def diffuse_fill(images: DataFrame, rounds: int | None = None) -> DataFrame:
    """images(image_id, w, h, rgba, known) with unknown pixels filled, `rounds` rounds or until nothing changes; one image is one row, so no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                p = np.frombuffer(row["rgba"], np.uint8).reshape(row["h"], row["w"], 4).copy()
                p, known = diffuse_block(p, np.frombuffer(row["known"], np.uint8).reshape(row["h"], row["w"]) > 0, rounds)
                out.append((row["image_id"], row["w"], row["h"], p.tobytes(), int((~known).sum()), known.astype(np.uint8).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()], strict=True)], ["image_id", "w", "h", "rgba", "unfilled", "known"])

    return images.select(C("image_id").cast("long").alias("image_id"), C("w").cast("int").alias("w"), C("h").cast("int").alias("h"), "rgba", "known").mapInArrow(run, "image_id long, w int, h int, rgba binary, unfilled int, known binary")


def _filled_pixels(images: DataFrame) -> DataFrame:
    """The pixels of filled images, and is_fill for those that no round reached."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = np.frombuffer(row["rgba"], np.uint8).reshape(-1, 4).astype(np.int32)
                at = np.arange(len(p), dtype=np.int32)
                left = np.frombuffer(row["known"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row["image_id"], np.int64)), pa.array(at % row["w"], pa.int32()), pa.array(at // row["w"], pa.int32()), *(pa.array(p[:, k]) for k in range(4)), pa.array(left)], ["image_id", "x", "y", *"rgba", "is_fill"])

    return images.select("image_id", "w", "rgba", "known").mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int, is_fill boolean")


def decode_pipeline(pixels: DataFrame, presets: DataFrame, rounds: int | None = None) -> DataFrame:
    """Decode with an image's preset (image_id, low, high, contrast), else with the window of its histogram; then diffuse for `rounds` rounds or until nothing changes."""
    window = auto_window(luma_histogram(pixels)).join(presets.select("image_id", C("low").alias("pl"), C("high").alias("ph"), C("contrast").alias("pc")), "image_id", "left")
    window = window.select("image_id", F.coalesce("pl", "low").alias("low"), F.coalesce("ph", "high").alias("high"), F.coalesce("pc", F.lit(0)).alias("contrast"))
    decoded = window_decode(with_pixels(window, pixels))
    return diffuse_round(decoded) if rounds == 1 else _filled_pixels(diffuse_fill(to_known_images(decoded), rounds))
