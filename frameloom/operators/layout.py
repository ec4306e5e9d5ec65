"""Layout geometry: slicing, stitching, grids, collages, sheets, layers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.components import connected_components
from frameloom.sources.scratch import keep, materialize, scratch_run

C = F.col


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def slice_grid(items: DataFrame, rows: int, cols: int, square: bool) -> DataFrame:
    """Tiles of items(group_id, pos, w, h): cells of whole pixels, what is left over is dropped."""
    side = F.least("w", "h")
    cut = square and rows > 1
    w, h = (side, side) if cut else (C("w"), C("h"))
    left, top = (F.floor((C("w") - side) / 2), F.floor((C("h") - side) / 2)) if cut else (F.lit(0), F.lit(0))
    cell_w, cell_h = F.floor(w / cols), F.floor(h / rows)
    cells = items.select("group_id", "pos", cell_w.alias("tw"), cell_h.alias("th"), left.alias("x0"), top.alias("y0"), F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("i"))
    return cells.filter("tw > 0 AND th > 0").select("group_id", "pos", (C("i") + 1).alias("tile"), (C("x0") + C("i") % cols * C("tw")).cast("long").alias("x"), (C("y0") + F.floor(C("i") / cols) * C("th")).cast("long").alias("y"), C("tw").cast("long").alias("w"), C("th").cast("long").alias("h"))


def stitch_layout(items: DataFrame, vertical: bool, unify: str, gap: int, margin: int) -> DataFrame:
    """Places of a group's items in a row or a column, and the size of the canvas.

    unify is min, max or none: all take the least or largest cross side, or keep their size.
    """
    whole = Window.partitionBy("group_id")
    before = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cross, along = ("w", "h") if vertical else ("h", "w")
    base = {"min": F.min(cross).over(whole), "max": F.max(cross).over(whole), "none": C(cross)}[unify]
    sized = items.withColumn("c", base).withColumn("l", F.greatest(F.lit(1).cast("long"), js_round(C(along) * (C("c") / C(cross)))))
    placed = sized.withColumns({
        "at": margin + F.coalesce(F.sum(C("l") + gap).over(before), F.lit(0)), "widest": F.max("c").over(whole), "length": F.sum("l").over(whole) + gap * (F.count("*").over(whole) - 1) + 2 * margin})
    off = margin + F.floor((C("widest") - C("c")) / 2)
    x, y, w, h = (off, C("at"), C("c"), C("l")) if vertical else (C("at"), off, C("l"), C("c"))
    cw, ch = (C("widest") + 2 * margin, C("length")) if vertical else (C("length"), C("widest") + 2 * margin)
    return placed.select("group_id", "pos", *(v.cast("long").alias(k) for k, v in {"x": x, "y": y, "w": w, "h": h, "canvas_w": cw, "canvas_h": ch}.items()))


#: Columns and rows of the fixed grids in landscape; portrait swaps them (fixed values).
GRIDS = {2: (2, 1), 4: (2, 2), 6: (3, 2), 8: (4, 2), 9: (3, 3), 16: (4, 4)}


def grid_dims(n: Column, portrait: Column) -> Column:
    """STRUCT(cols, rows) of a grid of n cells; other n count as six."""
    out = F.when(portrait, F.struct(F.lit(2).alias("cols"), F.lit(3).alias("rows"))).otherwise(F.struct(F.lit(3).alias("cols"), F.lit(2).alias("rows")))
    for k, (a, b) in GRIDS.items():
        out = F.when(n == k, F.when(portrait, F.struct(F.lit(b).alias("cols"), F.lit(a).alias("rows"))).otherwise(F.struct(F.lit(a).alias("cols"), F.lit(b).alias("rows")))).otherwise(out)
    return out


def _regions(layout_id, segments: list[tuple[str, float, float, float]], cols: float, rows: float) -> list[tuple]:
    """Regions of one layout: cells between all cut positions, joined where no segment parts them."""
    near = lambda v: round(v, 6)
    cuts = {k: sorted({0.0, float(far)} | {near(p) for kind, p, lo, hi in segments if kind == k}) for k, far in (("v", cols), ("h", rows))}
    xs, ys = cuts["v"], cuts["h"]
    nx, ny = len(xs) - 1, len(ys) - 1

    def parted(kind: str, pos: float, a: float, b: float) -> bool:
        return any(k == kind and abs(near(p) - pos) < 1e-6 and lo < b - 1e-6 and hi > a + 1e-6 for k, p, lo, hi in segments)

    root = list(range(nx * ny))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j in range(ny):
        for i in range(nx):
            if i + 1 < nx and not parted("v", xs[i + 1], ys[j], ys[j + 1]):
                a, b = sorted((find(j * nx + i), find(j * nx + i + 1)))
                root[b] = a
            if j + 1 < ny and not parted("h", ys[j + 1], xs[i], xs[i + 1]):
                a, b = sorted((find(j * nx + i), find((j + 1) * nx + i)))
                root[b] = a
    cells: dict[int, list[int]] = {}
    for c in range(nx * ny):
        cells.setdefault(find(c), []).append(c)
    return [(layout_id, n, min(xs[c % nx] for c in own), min(ys[c // nx] for c in own), max(xs[c % nx + 1] for c in own), max(ys[c // nx + 1] for c in own), len(own)) for n, own in enumerate(cells[k] for k in sorted(cells))]


def grid_regions(segments: DataFrame, cols: float, rows: float) -> DataFrame:
    """Regions of segments(layout_id, kind, pos, lo, hi) on a sheet of cols by rows, in the order of their first cells.

    A layout is a handful of rows that one person drew, so each fits a call; many layouts spread by key.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = list(frame[["kind", "pos", "lo", "hi"]].itertuples(index=False, name=None))
        return pd.DataFrame(_regions(int(frame["layout_id"].iloc[0]), parts, cols, rows), columns=["layout_id", "region", "x0", "y0", "x1", "y1", "cells"])

    return segments.groupBy("layout_id").applyInPandas(run, "layout_id long, region int, x0 double, y0 double, x1 double, y1 double, cells int")


#: Bands of a sheet's side in which positions are ranked.
BANDS = 256
#: Positions nearer than this are one.
NEAR = 1e-6


def _ranked(cuts: DataFrame, asked: DataFrame, far: Column) -> DataFrame:
    """asked(layout_id, kind, value, ...) with `upto`, the cuts (layout_id, kind, pos) at or below the value.

    Positions fall into bands of the side. Counts of whole bands are summed over a layout's BANDS rows, and only inside a band are
    positions sorted, so a layout of very many segments is ranked by as many tasks.
    """
    band = lambda v: F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor(v * BANDS / far))).cast("int")
    whole = cuts.groupBy("layout_id", "kind", band(C("pos")).alias("band")).agg(F.count("*").alias("n"))
    before = whole.select("layout_id", "kind", C("band").alias("b"), "n", F.explode(F.sequence(C("band") + 1, F.lit(BANDS))).alias("band")).groupBy("layout_id", "kind", "band").agg(F.sum("n").alias("before"))
    names = asked.columns
    probes = asked.select(F.struct(*names).alias("row"), "layout_id", "kind", band(C("value")).alias("band"), "value", F.lit(1).alias("is_probe"))
    marks = cuts.select(F.lit(None).cast(probes.schema["row"].dataType).alias("row"), "layout_id", "kind", band(C("pos")).alias("band"), C("pos").alias("value"), F.lit(0).alias("is_probe"))
    inside = F.sum(1 - C("is_probe")).over(Window.partitionBy("layout_id", "kind", "band").orderBy("value", "is_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = probes.unionByName(marks).withColumn("inside", inside).filter("is_probe = 1")
    return seen.join(before, ["layout_id", "kind", "band"], "left").select("row.*", (C("inside") + F.coalesce("before", F.lit(0))).cast("int").alias("upto"))


def spread_regions(segments: DataFrame, cols: float, rows: float) -> DataFrame:
    """grid_regions() with no task that holds a layout: cells and their borders are rows, regions are connected components.

    Positions are whole millionths here, so those that grid_regions() takes as one because they differ by a millionth stay two.
    """
    far = F.when(C("kind") == "v", float(cols)).otherwise(float(rows))
    with scratch_run(segments.sparkSession, "regions"):
        drawn = materialize(segments.filter(C("kind").isin("v", "h")).select("layout_id", "kind", F.round("pos", 6).alias("pos"), "lo", "hi").distinct(), "drawn")
        sides = segments.select("layout_id").distinct().select("layout_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("pos")) for k, p in (("v", 0), ("v", cols), ("h", 0), ("h", rows))))).alias("s")).select("layout_id", "s.*")
        cuts = materialize(drawn.select("layout_id", "kind", "pos").unionByName(sides).distinct(), "cuts")
        # Every cut with its number, and where the next one lies.
        numbered = materialize(_ranked(cuts, cuts.withColumn("value", C("pos")), far).select("layout_id", "kind", "pos", (C("upto") - 1).alias("k")), "numbered")
        sizes = materialize(numbered.groupBy("layout_id").agg((F.max(F.when(C("kind") == "v", C("k")))).alias("nx"), (F.max(F.when(C("kind") == "h", C("k")))).alias("ny")), "sizes")

        # Which cells a segment stands beside: ranks of its ends among the cuts of the other kind.
        other = F.when(C("kind") == "v", "h").otherwise("v")
        ends = drawn.select("layout_id", other.alias("kind"), "kind", "pos", F.explode(F.array(F.struct(F.lit(True).alias("first"), (C("lo") + 1.5 * NEAR).alias("value")), F.struct(F.lit(False).alias("first"), (C("hi") - 1.5 * NEAR).alias("value")))).alias("e"), "lo", "hi")
        ends = ends.toDF("layout_id", "across", "own", "pos", "e", "lo", "hi").select("layout_id", C("across").alias("kind"), "own", "pos", "lo", "hi", "e.first", "e.value")
        spans = _ranked(cuts, ends, far).groupBy("layout_id", C("own").alias("kind"), "pos", "lo", "hi").agg(F.max(F.when(C("first"), C("upto"))).alias("a"), F.max(F.when(~C("first"), C("upto"))).alias("b"))
        borders = spans.join(numbered, ["layout_id", "kind", "pos"]).select("layout_id", "kind", "k", F.greatest(C("a") - 1, F.lit(0)).alias("a"), (C("b") - 1).alias("b")).filter("a <= b")
        borders = materialize(borders.select("layout_id", "kind", "k", F.explode(F.sequence("a", "b")).alias("at")).distinct(), "borders")

        lines = numbered.filter("kind = 'h'").join(sizes, "layout_id").filter("k < ny").select("layout_id", C("k").alias("j"), "nx", "ny")
        cells = lines.select("layout_id", "j", "nx", "ny", F.explode(F.sequence(F.lit(0), C("nx") - 1)).alias("i"))
        cell = lambda i, j: F.struct(C("layout_id"), (j * C("nx") + i).cast("long").alias("cell"))
        right = cells.filter("i + 1 < nx").select("layout_id", F.lit("v").alias("kind"), (C("i") + 1).alias("k"), C("j").alias("at"), cell(C("i"), C("j")).alias("a"), cell(C("i") + 1, C("j")).alias("b"))
        below = cells.filter("j + 1 < ny").select("layout_id", F.lit("h").alias("kind"), (C("j") + 1).alias("k"), C("i").alias("at"), cell(C("i"), C("j")).alias("a"), cell(C("i"), C("j") + 1).alias("b"))
        near = right.unionByName(below).join(borders, ["layout_id", "kind", "k", "at"], "left_anti").select("a", "b")
        members = connected_components(near).select(C("node").alias("c"), C("component.cell").alias("root"))
        owned = cells.withColumn("c", cell(C("i"), C("j"))).join(members, "c", "left").select("layout_id", "i", "j", F.coalesce("root", "c.cell").alias("root"))

        boxes = owned.groupBy("layout_id", "root").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), (F.max("i") + 1).alias("i1"), (F.max("j") + 1).alias("j1"), F.count("*").cast("int").alias("cells"))
        for name, kind, at in (("x0", "v", "i0"), ("y0", "h", "j0"), ("x1", "v", "i1"), ("y1", "h", "j1")):
            boxes = boxes.join(numbered.filter(C("kind") == kind).select("layout_id", C("k").alias(at), C("pos").alias(name)), ["layout_id", at])
        number = F.row_number().over(Window.partitionBy("layout_id").orderBy("root")) - 1
        return keep(boxes.select(C("layout_id").cast("long").alias("layout_id"), number.alias("region"), "x0", "y0", "x1", "y1", "cells"), "regions")


def split_region(regions: DataFrame, vertical: bool, n: int) -> DataFrame:
    """The n-1 segments that cut each region's box into n equal parts."""
    k = regions.select("layout_id", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("k")) if n > 1 else regions.select("layout_id", "x0", "y0", "x1", "y1", F.lit(0).alias("k")).filter("false")
    a, b, lo, hi = ("x0", "x1", "y0", "y1") if vertical else ("y0", "y1", "x0", "x1")
    return k.select("layout_id", F.lit("v" if vertical else "h").alias("kind"), F.round(C(a) + (C(b) - C(a)) * C("k") / n, 6).alias("pos"), C(lo).alias("lo"), C(hi).alias("hi"))


def remove_segment(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Take spans (layout_id, kind, pos, lo, hi) out of the segments at the same place; what sticks out stays."""
    s, p = segments.alias("s"), spans.withColumn("pos6", F.round("pos", 6)).alias("p")
    keyed = segments.withColumn("pos6", F.round("pos", 6))
    hit = (C("s.layout_id") == C("p.layout_id")) & (C("s.kind") == C("p.kind")) & (C("s.pos6") == C("p.pos6")) & (C("s.lo") < C("p.hi")) & (C("p.lo") < C("s.hi"))
    s = keyed.alias("s")
    cut = s.join(p, hit).select("s.layout_id", "s.kind", "s.pos", F.explode(F.array(F.struct(C("s.lo").alias("lo"), F.least("s.hi", "p.lo").alias("hi")), F.struct(F.greatest("s.lo", "p.hi").alias("lo"), C("s.hi").alias("hi")))).alias("e"))
    parts = cut.select("layout_id", "kind", "pos", "e.*").filter("hi - lo > 0.000001")
    return s.join(p, hit, "left_anti").select("layout_id", "kind", "pos", "lo", "hi").unionByName(parts)


def collage_layout(items: DataFrame, regions: DataFrame, fit: str, width: int = 960) -> DataFrame:
    """The k-th picture of each group into the k-th region; pictures without a region are dropped.

    items(group_id, pos, w, h, fit_override), regions(region, x0, y0, x1, y1). The height follows the first picture.
    """
    w = Window.partitionBy("group_id").orderBy("pos")
    ranked = items.withColumns({"k": F.row_number().over(w) - 1, "height": F.greatest(F.lit(1).cast("long"), js_round(width * F.first(C("h") / C("w")).over(w)))})
    pixel = lambda e, size: C(e) * size
    return ranked.join(regions, C("k") == C("region")).select(
        "group_id", "pos", "region", F.coalesce("fit_override", F.lit(fit)).alias("fit"), pixel("x0", width).alias("x"), pixel("y0", C("height")).alias("y"),
        (pixel("x1", width) - pixel("x0", width)).alias("w"), (pixel("y1", C("height")) - pixel("y0", C("height"))).alias("h"))


#: Photo sizes in pixels at 300 dpi; the sheet and its gap (fixed values).
PRINT_SIZES = {"1": (295, 413), "s1": (260, 378), "b1": (390, 567), "2": (413, 579), "s2": (413, 531), "b2": (413, 626)}
SHEET, GAP = (1500, 1050), 30


def print_sheet(photos: DataFrame) -> DataFrame:
    """Places of the copies of each photo (id, size_key) on a sheet, and whether they fit on it."""
    sizes = F.create_map(*(x for k, (w, h) in PRINT_SIZES.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))))
    s = photos.withColumn("s", F.try_element_at(sizes, C("size_key"))).filter(C("s").isNotNull()).select("id", "size_key", "s.w", "s.h")
    s = s.withColumns({"cols": F.when(C("h") <= 531, 4).otherwise(2), "rows": F.lit(2)})
    s = s.withColumns({"x0": F.floor((SHEET[0] - C("cols") * C("w") - (C("cols") - 1) * GAP) / 2), "y0": F.floor((SHEET[1] - C("rows") * C("h") - (C("rows") - 1) * GAP) / 2)})
    cells = s.select("*", F.explode(F.sequence(F.lit(0), C("cols") * C("rows") - 1)).alias("i"))
    return cells.select("id", "size_key", C("i").alias("cell"), (C("x0") + C("i") % C("cols") * (C("w") + GAP)).alias("x"), (C("y0") + F.floor(C("i") / C("cols")) * (C("h") + GAP)).alias("y"), "w", "h", ((C("x0") >= 0) & (C("y0") >= 0)).alias("fits"))


def portrait_placement(sw: Column, sh: Column, w: int, h: int, scale: Column, dx: Column, dy: Column) -> Column:
    """Where a portrait lands on a photo of w by h: scaled by height, centred, eight hundredths of its height up; dx, dy are shares of the photo."""
    k = F.lit(h * 4.0 / 3) / sh * scale
    pw, ph = sw * k, sh * k
    return F.struct(pw.alias("w"), ph.alias("h"), ((w - pw) / 2 + dx * w).alias("x"), ((h - ph) / 2 - ph * 0.08 + dy * h).alias("y"))


def default_layers(items: DataFrame, w: int, h: int) -> DataFrame:
    """First places of a group's pictures as layers: two columns, rows as many as there are pictures so far."""
    i = F.row_number().over(Window.partitionBy("group_id").orderBy("pos")) - 1
    half = int(w / 2 + 0.5)
    return items.withColumn("i", i).select(
        "group_id", "pos", C("i").alias("z"), F.lit(half).alias("w"), js_round(half * C("h") / C("w")).alias("h"), (C("i") % 2 * half).alias("x"),
        (F.floor(C("i") / 2) * js_round(h / F.ceil((C("i") + 1) / 2))).alias("y"))


def layer_size(layers: DataFrame) -> DataFrame:
    """New sides of layers(id, w, h, new_w, new_h, free): a missing one follows the ratio, or stays when free; both missing are refused."""
    one = lambda new, other_new, own, other: F.coalesce(new, F.when(C("free"), own.cast("long")).otherwise(js_round(own * other_new / other)))
    w, h = one(C("new_w"), C("new_h"), C("w"), C("h")), one(C("new_h"), C("new_w"), C("h"), C("w"))
    asked = layers.filter(C("new_w").isNotNull() | C("new_h").isNotNull())
    least = F.lit(1).cast("long")
    return asked.select("id", F.greatest(least, w.cast("long")).alias("w"), F.greatest(least, h.cast("long")).alias("h"))
