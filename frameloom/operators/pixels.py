"""Pixel maps over pixels(image_id, x, y, r, g, b, a): narrow expressions, no shuffle unless images shrink or are packed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
RGB = ("r", "g", "b")
#: The most pixels and the longest side before an image is scaled down (fixed values).
MAX_PIXELS, MAX_SIDE = 20_000_000, 6_000
FRAME_PIXELS, ANIMATION_PIXELS = 8_000_000, 300_000_000


def store(c: Column) -> Column:
    """What a clamped byte array keeps of a number: half-to-even rounding, 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c, 0))).cast("int")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def luma(r: Column, g: Column, b: Column, stored: bool = True) -> Column:
    """Brightness .299 r + .587 g + .114 b; stored, or rounded half up as histograms take it."""
    v = r * 0.299 + g * 0.587 + b * 0.114
    return store(v) if stored else half_up(v)


#: Keys that the lines of one image are dealt over where images are joined with rows about them.
LINES = 32


def with_pixels(rows: DataFrame, pixels: DataFrame) -> DataFrame:
    """rows(image_id, ...) beside each pixel of their images, in no order.

    Lines are dealt over LINES keys on both sides, so an image of any size is no single task; what is repeated is the row about
    an image, not its pixels. Spark broadcasts the rows where they are small.
    """
    dealt = rows.withColumn("_line", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1))))
    return dealt.join(pixels.withColumn("_line", F.pmod(C("y"), F.lit(LINES)).cast("int")), ["image_id", "_line"]).drop("_line")


def _packed(pixels: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """images(image_id, w, h, ...): one row for each image, every part's bytes (given as hex for a pixel) in row order.

    Scan lines are packed first, each in a task of its own, so an image is gathered as a row for each line and not
    for each pixel.
    """
    def joined(rows: Column, part: str) -> Column:
        return F.array_join(F.transform(rows, lambda s: s[part]), "").alias(part)

    held = pixels.select("image_id", "y", F.struct("x", *(v.alias(k) for k, v in parts.items())).alias("p"))
    lines = held.groupBy("image_id", "y").agg((F.max("p.x") + 1).alias("w"), F.sort_array(F.collect_list("p")).alias("p"))
    lines = lines.select("image_id", "w", F.struct("y", *(joined(C("p"), k) for k in parts)).alias("l"))
    whole = lines.groupBy("image_id").agg(F.max("w").alias("w"), (F.max("l.y") + 1).alias("h"), F.sort_array(F.collect_list("l")).alias("l"))
    return whole.select("image_id", "w", "h", *(F.unhex(joined(C("l"), k)).alias(k) for k in parts))


def _rgba_hex() -> Column:
    byte = lambda c: F.lpad(F.substring(F.hex(C(c).cast("int")), -2, 2), 2, "0")
    return F.concat(*map(byte, "rgba"))


def to_images(pixels: DataFrame) -> DataFrame:
    """images(image_id, w, h, rgba): one row for each image, bytes in row order."""
    return _packed(pixels, {"rgba": _rgba_hex()})


def to_known_images(decoded: DataFrame) -> DataFrame:
    """images(image_id, w, h, rgba, known) of decoded pixels, in one pass: known has a byte for each pixel, 1 where it is not to be filled."""
    return _packed(decoded, {"rgba": _rgba_hex(), "known": F.when(C("is_fill"), "00").otherwise("01")})


def to_pixels(images: DataFrame) -> DataFrame:
    """The pixels of image blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = np.frombuffer(row["rgba"], np.uint8).reshape(-1, 4).astype(np.int32)
                at = np.arange(len(p), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row["image_id"], np.int64)), pa.array(at % row["w"], pa.int32()), pa.array(at // row["w"], pa.int32()), *(pa.array(p[:, k]) for k in range(4))], ["image_id", "x", "y", *"rgba"])

    return images.select(C("image_id").cast("long").alias("image_id"), C("w").cast("int").alias("w"), "rgba").mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int")


def strip_alpha_lsb(pixels: DataFrame) -> DataFrame:
    """Clear the lowest bit of alpha; what turns fully clear turns white. changed tells which pixels differ."""
    a = C("a").bitwiseAND(F.lit(254))
    new = {c: F.when(a == 0, 255).otherwise(C(c)).cast("int") for c in RGB}
    changed = (a != C("a")) | ((a == 0) & ((C("r") != 255) | (C("g") != 255) | (C("b") != 255)))
    return pixels.select("image_id", "x", "y", *(v.alias(k) for k, v in new.items()), a.alias("a"), changed.alias("changed"))


def _noise(seed: int, channel: int, width: int) -> Column:
    """A whole number in -width..width from the seed, the image and the place."""
    mixed = (C("image_id") * 7919 + C("x") * 104729 + C("y") * 1299709 + channel * 15485863 + seed * 49979687) % 2147483647
    mixed = mixed * 48271 % 2147483647
    return (mixed % (2 * width + 1) - width).cast("int")


def channel_jitter(pixels: DataFrame, seed: int) -> DataFrame:
    """Each channel shifts by -2 to 2, then by its image's tint of -1 to 1; alpha stays."""
    def tint(k: int) -> Column:
        return (((C("image_id") * 7919 + k * 15485863 + seed * 49979687) % 2147483647) * 48271 % 2147483647 % 3 - 1).cast("int")

    new = [clamp(clamp(C(c) + _noise(seed, k, 2)) + tint(k)).alias(c) for k, c in enumerate(RGB)]
    return pixels.select("image_id", "x", "y", *new, "a")


def gaussian_noise(pixels: DataFrame, k: float, seed: int) -> DataFrame:
    """(1-k) of the pixel and k of normal noise, by the Box-Muller transform of two hashed uniforms."""
    def uniform(n: int) -> Column:
        mixed = (C("image_id") * 7919 + C("x") * 104729 + C("y") * 1299709 + n * 15485863 + seed * 49979687) % 2147483647 * 48271 % 2147483647
        return (mixed + 1) / F.lit(2147483648.0)

    def normal(n: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(2 * n))) * F.cos(2 * np.pi * uniform(2 * n + 1))

    new = [clamp(half_up((1 - k) * C(c) + k * normal(n) * 255)).alias(c) for n, c in enumerate(RGB)]
    return pixels.select("image_id", "x", "y", *new, "a")


def green_mix(pixels: DataFrame, k: float) -> DataFrame:
    """A share k of green, a little darker, with the green channel lifted."""
    to = {"r": 0, "g": 255, "b": 0}
    new = [clamp(half_up(C(c) * (1 - k) + to[c] * k - 128 * k + (32 * k if c == "g" else 0))).alias(c) for c in RGB]
    return pixels.select("image_id", "x", "y", *new, "a")


def _drift(r, g, b, floor, clip):
    """One integer pass to brightness and colour differences and back (fixed values); each step down by one and each shift loses a little.

    Shifts of numbers below zero round down, so they are floors of quotients.
    """
    y = clip(floor((150 * r + 77 * g + 29 * b) / 256) - 1, 0, 255)
    u = clip(floor((-85 * r - 43 * g + 128 * b) / 256) - 1, -128, 127)
    v = clip(floor((-107 * r + 128 * g - 21 * b) / 256) - 1, -128, 127)
    back = (116130 * u, -22553 * u - 46802 * v, 91881 * v)
    return tuple(clip(floor((65536 * y + d) / 65536), 0, 255) for d in back)


def yuv_drift(pixels: DataFrame, rounds: int) -> DataFrame:
    """rounds passes; up to three stay columns, more run as whole-array arithmetic in Arrow batches."""
    if rounds <= 3:
        out = pixels
        for _ in range(rounds):
            new = _drift(C("r"), C("g"), C("b"), F.floor, lambda v, low, high: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), v)))
            out = out.withColumns({c: v.cast("int") for c, v in zip(RGB, new, strict=True)})
        return out.select("image_id", "x", "y", *RGB, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = [batch.column(3 + k).to_numpy().astype(np.int64) for k in range(3)]
            for _ in range(rounds):
                rgb = [v.astype(np.int64) for v in _drift(*rgb, np.floor, np.clip)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c.astype(np.int32)) for c in rgb), batch.column(6)], batch.schema.names)

    shaped = pixels.select(C("image_id").cast("long").alias("image_id"), *(C(c).cast("int").alias(c) for c in ("x", "y", *RGB, "a")))
    return shaped.mapInArrow(run, shaped.schema)


def overlay_corner(pixels: DataFrame, mark: DataFrame, mark_w: int, mark_h: int, w: int, h: int) -> DataFrame:
    """Paint a mark over the bottom right corner, by alpha; a mark larger than the image is skipped.

    The mark is a single image; Spark broadcasts it while it is small.
    """
    if mark_w > w or mark_h > h:
        return pixels
    m = mark.select((C("x") + (w - mark_w)).alias("x"), (C("y") + (h - mark_h)).alias("y"), *(C(c).alias(f"m{c}") for c in "rgba"))
    over = lambda c: F.when(C("ma").isNull(), C(c)).otherwise(store(C(f"m{c}") * C("ma") / 255 + C(c) * (255 - C("ma")) / 255))
    return pixels.join(m, ["x", "y"], "left").select("image_id", "x", "y", *(over(c).cast("int").alias(c) for c in RGB), F.greatest(C("a"), F.coalesce("ma", F.lit(0))).cast("int").alias("a"))


def resize(pixels: DataFrame, w: int, h: int, ratio: float) -> DataFrame:
    """Area average into max(1, round(side * ratio)) pixels a side, for any ratio.

    A target pixel is the mean of the source pixels under it, each weighted by the area it covers; growing, that
    is the source pixel itself or a mix at its borders. Areas are whole numbers (in parts of new_w by new_h), so the sums
    are exact. Each source pixel gives a row for each target pixel it meets, combined before the shuffle.
    """
    new_w, new_h = max(1, int(w * ratio + 0.5)), max(1, int(h * ratio + 0.5))

    def covers(c: str, new: int, old: int) -> Column:
        # In units of 1 / (old * new) of the side a source pixel spans c * new to (c + 1) * new, a target pixel old of them.
        first, last = F.floor(C(c) * new / old), F.floor(((C(c) + 1) * new - 1) / old)
        part = lambda t: (F.least((C(c) + 1) * new, (t + 1) * old) - F.greatest(C(c) * new, t * old))
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.cast("int").alias("at"), part(t).cast("long").alias("part")))

    met = pixels.select("image_id", *"rgba", "y", F.explode(covers("x", new_w, w)).alias("tx")).select("image_id", *"rgba", "tx", F.explode(covers("y", new_h, h)).alias("ty"))
    area = C("tx.part") * C("ty.part")
    return met.groupBy("image_id", C("tx.at").alias("x"), C("ty.at").alias("y")).agg(*(store(F.sum(C(c) * area) / F.sum(area)).alias(c) for c in "rgba"))


def _image_blocks(images: DataFrame, change) -> DataFrame:
    """images(image_id, w, h, rgba) with change(image_id, picture of (h, w, 4)) in place of each picture; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = change(row["image_id"], np.frombuffer(row["rgba"], np.uint8).reshape(row["h"], row["w"], 4))
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]], pa.int64()), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[0]], pa.int32()), pa.array([out.astype(np.uint8).tobytes()], pa.binary())], ["image_id", "w", "h", "rgba"])

    whole = images.filter(C("rgba").isNotNull() & (C("w") > 0) & (C("h") > 0))
    return whole.select(C("image_id").cast("long").alias("image_id"), C("w").cast("int").alias("w"), C("h").cast("int").alias("h"), "rgba").mapInArrow(run, "image_id long, w int, h int, rgba binary")


def area_weights(old: int, new: int) -> np.ndarray:
    """How much of each of `old` pixels a line of `new` covers, in whole parts of old * new: (new, old)."""
    begins, targets = np.arange(old) * new, np.arange(new) * old
    return np.clip(np.minimum(begins + new, targets[:, None] + old) - np.maximum(begins, targets[:, None]), 0, None)


def resize_images(images: DataFrame, ratio: float) -> DataFrame:
    """resize() on image blocks of any size: the area average is a product with weights of rows and one with weights of columns."""
    def change(_, p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        new_w, new_h = max(1, int(w * ratio + 0.5)), max(1, int(h * ratio + 0.5))
        rows, columns = area_weights(h, new_h).astype(np.float64), area_weights(w, new_w).astype(np.float64)
        # Whole numbers below 2^53, so the sums are exact as those of the relational form are.
        sums = np.einsum("yj,jic->yic", rows, np.einsum("xi,jic->jxc", columns, p.astype(np.float64), optimize=True), optimize=True)
        return np.clip(np.rint(sums / (rows.sum(axis=1)[:, None] * columns.sum(axis=1))[..., None]), 0, 255)

    return _image_blocks(images, change)


def gaussian_noise_images(images: DataFrame, k: float, seed: int) -> DataFrame:
    """gaussian_noise() on image blocks: the same hashed uniforms for every place, all places of a picture at once."""
    m = 2147483647

    def change(image_id: int, p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        place = (image_id * 7919 + np.arange(w, dtype=np.int64)[None, :] * 104729 + np.arange(h, dtype=np.int64)[:, None] * 1299709 + seed * 49979687) % m
        uniform = lambda n: ((place + n * 15485863) % m * 48271 % m + 1) / 2147483648.0
        out = p.astype(np.float64)
        for c in range(3):
            normal = np.sqrt(-2 * np.log(uniform(2 * c))) * np.cos(2 * np.pi * uniform(2 * c + 1))
            out[..., c] = np.clip(np.floor((1 - k) * out[..., c] + k * normal * 255 + 0.5), 0, 255)
        return out

    return _image_blocks(images, change)


def flatten_alpha(pixels: DataFrame, background: int) -> DataFrame:
    new = [F.bround(C(c) * C("a") / 255 + background * (255 - C("a")) / 255, 0).cast("int").alias(c) for c in RGB]
    return pixels.select("image_id", "x", "y", *new)


def weather(pixels: DataFrame, mode: str, noise: float, green: float, ratio: float, w: int, h: int, seed: int = 1, mark: DataFrame | None = None, mark_w: int = 0, mark_h: int = 0) -> DataFrame:
    """The ageing chain: a mark in the corner (if one is given), noise, then drift (mode classic) or green mix, then scale.

    A stage whose strength is 0 (1 for the scale) is left out. Re-encoding as JPEG, the chain's codec stage, is not part of it.
    """
    out = overlay_corner(pixels, mark, mark_w, mark_h, w, h) if mark is not None else pixels
    out = gaussian_noise(out, noise, seed) if noise > 0 else out
    if green > 0:
        out = yuv_drift(out, int(green * 100 + 0.5)) if mode == "classic" else green_mix(out, green)
    return resize(out, w, h, ratio) if ratio != 1 else out


#: noise, green and scale of the presets (fixed values).
PRESETS = {"low": (0.0, 0.05, 1.0), "medium": (0.02, 0.1, 1.0), "high": (0.05, 0.15, 1.0)}


def size_cap(w: Column, h: Column) -> tuple[Column, Column]:
    """Sides after scaling down to the most pixels and the longest side."""
    s = F.least(F.sqrt(F.lit(float(MAX_PIXELS)) / (w * h)), F.lit(float(MAX_SIDE)) / w, F.lit(float(MAX_SIDE)) / h, F.lit(1.0))
    side = lambda c: F.greatest(F.lit(1).cast("long"), F.floor(c * s + 0.5))
    return side(w), side(h)


def thumb_factor(w: Column, h: Column, side: int = 120) -> Column:
    """The power of two by which a thumbnail shrinks: doubled while both halves, so divided, stay at `side` or more."""
    more = F.sequence(F.lit(0), F.lit(20))
    half = lambda c: F.floor(c / 2)
    holds = lambda k: (F.floor(half(w) / F.pow(F.lit(2.0), k)) >= side) & (F.floor(half(h) / F.pow(F.lit(2.0), k)) >= side)
    steps = F.size(F.filter(more, holds))
    return F.when((w > side) | (h > side), F.pow(F.lit(2.0), steps).cast("int")).otherwise(F.lit(1))


def pixel_budget(w: Column, h: Column, frames: Column) -> Column:
    """Why a job is refused, or null: sizes of zero, a frame too large, an animation too large."""
    area = w.cast("long") * h.cast("long")
    return F.when((w <= 0) | (h <= 0), "empty").when(area > FRAME_PIXELS, "frame").when(area * frames > ANIMATION_PIXELS, "animation")
