"""Joins of several images, pixel by pixel. The join key holds the pair and the place, so one large image
spreads over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.pixels import clamp, store, with_pixels

C = F.col


def paired(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels of pairs(pair_id, inner_id, cover_id): r, g, b, a of the inner image, cr, cg, cb, ca of the cover.

    Both images meet their pairs in one join, dealt by lines, and each other in one aggregate by place; pair_ids are distinct.
    """
    roles = pairs.select("pair_id", F.explode(F.array(F.struct(C("inner_id").alias("image_id"), F.lit(True).alias("inner")), F.struct(C("cover_id").alias("image_id"), F.lit(False).alias("inner")))).alias("p")).select("pair_id", "p.*")
    met = with_pixels(roles, pixels.select("image_id", "x", "y", *"rgba"))
    sides = [F.max(F.when(C("inner") == inner, C(c))).alias(f"{'' if inner else 'c'}{c}") for inner in (True, False) for c in "rgba"]
    both = met.groupBy("pair_id", "x", "y").agg(F.bool_or("inner").alias("has_inner"), F.bool_or(~C("inner")).alias("has_cover"), *sides)
    return both.filter("has_inner AND has_cover").drop("has_inner", "has_cover")


def dual_blend(both: DataFrame, inner: Column, cover: Column, inner_share: float, cover_share: float) -> DataFrame:
    """A grey picture that shows the cover on white and the inner image on black: the alpha makes up the difference."""
    li, lc = F.floor(inner * inner_share), F.floor(255 - (255 - cover) * cover_share)
    a = 255 - lc + li
    g = F.when(a > 0, F.floor(li * 255 / a)).otherwise(0)
    first = (C("x") == 0) & (C("y") == 0)
    grey = F.when(first, 114).otherwise(clamp(g)).cast("int")
    return both.select("pair_id", "x", "y", grey.alias("r"), grey.alias("g"), grey.alias("b"), F.when(first, 255).otherwise(clamp(a)).cast("int").alias("a"))


def stripe_mask(x: Column, y: Column, slope: int, gap: int, is_row: bool) -> Column:
    """True on the stripes: gap of every gap+1 lines, along rows or columns, or slanted."""
    s = float(abs(slope))
    along, across = (y, x) if is_row else (x, y)
    place = along if slope == 0 else along / s + across
    return (place % (gap + 1)) < gap


def stripe_interleave(both: DataFrame, slope: int, gap: int, is_row: bool, inner_top: int, cover_low: int, reverse: bool) -> DataFrame:
    """Stripes of the cover squeezed into the light tones, inner pixels into the dark ones; reverse swaps the ranges."""
    mask = stripe_mask(C("x"), C("y"), slope, gap, is_row)

    def tone(c: str) -> Column:
        light = F.floor(C(f"c{c}") * (255 - cover_low) / 255 + (0 if reverse else cover_low))
        dark = F.floor(C(c) * inner_top / 255 + (255 - inner_top if reverse else 0))
        return F.when(mask, light).otherwise(dark).cast("int").alias(c)

    return both.select("pair_id", "x", "y", *(tone(c) for c in "rgb"), F.when(mask, C("ca")).otherwise(C("a")).alias("a"))


def layer_ranges(layers: DataFrame) -> DataFrame:
    """Default tone ranges of layers(set_id, n, ...): each starts five above the last, up to 254, and spans 24."""
    low = F.least(F.lit(254), (C("n") * 29).cast("int"))
    return layers.withColumns({"lo": low, "hi": F.least(F.lit(255), low + 24)})


def weighted_interleave(layers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each place of a set of images shows one of its layers, by weights along the diagonals, in the layer's tones."""
    w = Window.partitionBy("set_id")
    upto = F.sum("weight").over(w.orderBy("n"))
    ranges = layers.withColumns({"c1": upto, "c0": upto - C("weight"), "total": F.sum("weight").over(w)})
    shown = with_pixels(ranges, pixels)
    offset = (C("x") + C("y")) % C("total")

    def tone(c: str) -> Column:
        scaled = F.greatest(C("lo"), F.least(C(c) * (C("hi") - C("lo")) / 255 + C("lo"), C("hi")))
        return F.when(C("lo") >= C("hi"), C("lo")).otherwise(F.floor(scaled)).cast("int").alias(c)

    return shown.filter((offset >= C("c0")) & (offset < C("c1"))).select("set_id", "x", "y", "n", *(tone(c) for c in "rgb"), "a")


def fit_geometry(sw: Column, sh: Column, dw: int, dh: int, mode: str) -> Column:
    """Source rectangle and placement for contain, cover or stretch."""
    sw, sh = sw.cast("double"), sh.cast("double")
    k = (F.least if mode == "contain" else F.greatest)(dw / sw, dh / sh)
    zero = F.lit(0.0)
    if mode == "stretch":
        return F.struct(zero.alias("sx"), zero.alias("sy"), sw.alias("sw"), sh.alias("sh"), zero.alias("dx"), zero.alias("dy"), F.lit(float(dw)).alias("dw"), F.lit(float(dh)).alias("dh"))
    if mode == "contain":
        w, h = sw * k, sh * k
        return F.struct(zero.alias("sx"), zero.alias("sy"), sw.alias("sw"), sh.alias("sh"), ((dw - w) / 2).alias("dx"), ((dh - h) / 2).alias("dy"), w.alias("dw"), h.alias("dh"))
    w, h = dw / k, dh / k
    return F.struct(((sw - w) / 2).alias("sx"), ((sh - h) / 2).alias("sy"), w.alias("sw"), h.alias("sh"), zero.alias("dx"), zero.alias("dy"), F.lit(float(dw)).alias("dw"), F.lit(float(dh)).alias("dh"))


def pad_cover(covers: DataFrame, cw: int, ch: int, w: int, h: int, background: int) -> DataFrame:
    """Covers centred on a canvas that holds them scaled to fit (nearest pixel), the background elsewhere."""
    k = min(w / cw, h / ch)
    tw, th = max(1, int(cw * k + 0.5)), max(1, int(ch * k + 0.5))
    dx, dy = (w - tw) // 2, (h - th) // 2
    # Line by line, so that no row holds a whole canvas.
    grid = covers.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    grid = grid.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"), "y")
    inside = (C("x") >= dx) & (C("x") < dx + tw) & (C("y") >= dy) & (C("y") < dy + th)
    grid = grid.withColumns({"sx": F.when(inside, F.floor((C("x") - dx) * cw / tw).cast("int")), "sy": F.when(inside, F.floor((C("y") - dy) * ch / th).cast("int"))})
    source = covers.select("image_id", C("x").alias("sx"), C("y").alias("sy"), *(C(c).alias(f"s{c}") for c in "rgba"))
    out = grid.join(source, ["image_id", "sx", "sy"], "left")
    return out.select("image_id", "x", "y", *(F.coalesce(f"s{c}", F.lit(background)).alias(c) for c in "rgb"), F.coalesce("sa", F.lit(255)).alias("a"))


def composite_layers(layers: DataFrame, pixels: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Paint layers(canvas_id, z, image_id, x, y, w, h, rot, opacity) in order of z on a canvas of w by h.

    Every target place inside the bounds of a layer's turned box is mapped back to the source (turned about the box's
    centre), line by line, and the places that meet are folded by alpha in order.
    """
    cx, cy = C("x") + C("w") / 2, C("y") + C("h") / 2
    turn = F.radians(C("rot").cast("double"))
    reach_x, reach_y = (F.abs(F.cos(turn)) * C(a) / 2 + F.abs(F.sin(turn)) * C(b) / 2 for a, b in (("w", "h"), ("h", "w")))

    def span(centre: Column, reach: Column, most: int) -> Column:
        low, high = F.greatest(F.lit(0), F.floor(centre - reach).cast("int")), F.least(F.lit(most - 1), F.ceil(centre + reach).cast("int"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    cells = layers.select("*", F.explode(span(cy, reach_y, h)).alias("ty")).select("*", F.explode(span(cx, reach_x, w)).alias("tx"))
    dx, dy = C("tx") + 0.5 - cx, C("ty") + 0.5 - cy
    ux, uy = dx * F.cos(turn) + dy * F.sin(turn) + C("w") / 2, dy * F.cos(turn) - dx * F.sin(turn) + C("h") / 2
    inside = (ux >= 0) & (ux < C("w")) & (uy >= 0) & (uy < C("h"))
    mapped = cells.filter(inside).select("canvas_id", "z", "image_id", "opacity", C("tx").cast("int").alias("tx"), C("ty").cast("int").alias("ty"), F.floor(ux * sw / C("w")).cast("int").alias("x"), F.floor(uy * sh / C("h")).cast("int").alias("y"))
    met = mapped.join(pixels, ["image_id", "x", "y"]).groupBy("canvas_id", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("z", "r", "g", "b", (C("a") / 255 * C("opacity")).alias("k")))).alias("p"))
    start = F.struct(*(F.lit(255.0).alias(c) for c in "rgb"))
    over = F.aggregate("p", start, lambda s, p: F.struct(*((p[c] * p["k"] + s[c] * (1 - p["k"])).alias(c) for c in "rgb")))
    return met.select("canvas_id", C("tx").alias("x"), C("ty").alias("y"), over.alias("o")).select("canvas_id", "x", "y", *(store(C(f"o.{c}")).alias(c) for c in "rgb"))
