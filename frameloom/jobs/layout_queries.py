"""Registered queries over layouts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.jobs.session import job
from frameloom.operators import layout
from frameloom.sources.mapped import duck, table

C = F.col
#: Segments of drawn layouts on a sheet of 3 by 2, by layout number modulo 3: a full grid, an L, a split half cell.
DRAWN = [
    (0, "v", 1.0, 0.0, 2.0), (0, "v", 2.0, 0.0, 2.0), (0, "h", 1.0, 0.0, 3.0),
    (1, "v", 1.0, 0.0, 1.0), (1, "h", 1.0, 1.0, 3.0), (1, "v", 2.0, 1.0, 2.0),
    (2, "v", 1.5, 0.0, 2.0), (2, "h", 0.5, 0.0, 1.5), (2, "v", 0.75, 0.5, 2.0), (2, "h", 1.25, 1.5, 3.0),
]
_VALUES = ", ".join(f"({k}, '{kind}', CAST({p} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, kind, p, a, b in DRAWN)
#: Every image gets one of the drawn layouts.
SEGMENTS = "SELECT vec_id AS layout_id, kind, pos, lo, hi FROM {embeddings} JOIN (SELECT * FROM VALUES " + _VALUES + " AS s(k, kind, pos, lo, hi)) ON vec_id % 3 = k"
SEGMENTS_DUCK = "SELECT vec_id AS layout_id, kind, pos, lo, hi FROM embeddings JOIN (VALUES " + _VALUES + ") s(k, kind, pos, lo, hi) ON vec_id % 3 = k"
BOXES = [(0, 0.0, 0.0, 1.0 / 3, 1.0), (1, 1.0 / 3, 0.0, 1.0, 0.5), (2, 1.0 / 3, 0.5, 1.0, 1.0)]


def segments(spark, d):
    return spark.sql(SEGMENTS, embeddings=table(spark, d, "embeddings"))


def regions(spark, d):
    return layout.grid_regions(segments(spark, d), 3, 2)


def q_slice_grid(spark, d):
    return layout.slice_grid(table(spark, d, "items"), 3, 2, True)


def q_stitch_layout(spark, d):
    return layout.stitch_layout(table(spark, d, "items"), True, "min", 4, 10)


def q_stitch_layout_row(spark, d):
    return layout.stitch_layout(table(spark, d, "items"), False, "none", 3, 5)


def q_grid_dims(spark, d):
    t = table(spark, d, "items").withColumn("g", layout.grid_dims(C("w") % 17, C("pos") % 2 == 0))
    return t.select("group_id", "pos", "g.cols", "g.rows")


def q_spread_regions(spark, d):
    return layout.spread_regions(segments(spark, d), 3, 2)


def q_grid_regions(spark, d):
    return regions(spark, d)


def q_split_region(spark, d):
    return layout.split_region(regions(spark, d), True, 3)


def q_remove_segment(spark, d):
    s = segments(spark, d)
    spans = s.filter("kind = 'v'").select("layout_id", "kind", "pos", (C("lo") + 0.25).alias("lo"), (C("lo") + 0.5).alias("hi"))
    return layout.remove_segment(s, spans)


def q_collage_layout(spark, d):
    items = table(spark, d, "items").withColumn("fit_override", F.when(C("w") % 3 == 0, "contain"))
    boxes = spark.createDataFrame(BOXES, "region int, x0 double, y0 double, x1 double, y1 double")
    out = layout.collage_layout(items, boxes, "cover")
    return out.select("group_id", "pos", "region", "fit", *(F.round(c, 6).alias(c) for c in "xywh"))


def q_print_sheet(spark, d):
    keys = F.array(*map(F.lit, [*layout.PRINT_SIZES, "none"]))
    photos = table(spark, d, "customer").select(C("c_custkey").alias("id"), F.get(keys, (C("c_custkey") % 7).cast("int")).alias("size_key"))
    return layout.print_sheet(photos)


def q_portrait_placement(spark, d):
    p = layout.portrait_placement(C("w") * 10.0, C("h") * 10.0, 295, 413, 1 + C("pos") / 10.0, C("pos") / 100.0, F.lit(0.05))
    return table(spark, d, "items").select("group_id", "pos", p.alias("p")).select("group_id", "pos", *(F.round(f"p.{c}", 6).alias(c) for c in "whxy"))


def q_default_layers(spark, d):
    return layout.default_layers(table(spark, d, "items"), 1001, 700)


def q_layer_size(spark, d):
    asked = table(spark, d, "items").select((C("group_id") * 10 + C("pos")).alias("id"), "w", "h", F.when(C("w") % 3 != 0, C("h") * 2).alias("new_w"), F.when(C("w") % 3 != 1, C("w") * 3).alias("new_h"), (C("pos") % 2 == 0).alias("free"))
    return layout.layer_size(asked.withColumns({"new_w": F.when(C("w") % 5 != 0, C("new_w")), "new_h": F.when(C("w") % 5 != 0, C("new_h"))}))


QUERIES = {k[2:]: job(v) for k, v in list(globals().items()) if k.startswith("q_")}

_BOXES_DUCK = "(VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {e!r}::DOUBLE)" for k, a, b, c, e in BOXES) + ") b(region, x0, y0, x1, y1)"
_REGIONS = f"""
    WITH RECURSIVE s AS MATERIALIZED ({SEGMENTS_DUCK}),
    xs AS (SELECT layout_id, pos AS a, lead(pos) OVER (PARTITION BY layout_id ORDER BY pos) AS b, row_number() OVER (PARTITION BY layout_id ORDER BY pos) AS i FROM (SELECT DISTINCT layout_id, round(pos, 6) AS pos FROM s WHERE kind = 'v' UNION SELECT layout_id, unnest([0.0::DOUBLE, 3.0::DOUBLE]) FROM s)),
    ys AS (SELECT layout_id, pos AS a, lead(pos) OVER (PARTITION BY layout_id ORDER BY pos) AS b, row_number() OVER (PARTITION BY layout_id ORDER BY pos) AS j FROM (SELECT DISTINCT layout_id, round(pos, 6) AS pos FROM s WHERE kind = 'h' UNION SELECT layout_id, unnest([0.0::DOUBLE, 2.0::DOUBLE]) FROM s)),
    c AS MATERIALIZED (SELECT x.layout_id, i, j, j * 1000 + i AS c, x.a AS x0, x.b AS x1, y.a AS y0, y.b AS y1 FROM xs x JOIN ys y USING (layout_id) WHERE x.b IS NOT NULL AND y.b IS NOT NULL),
    e AS MATERIALIZED (
      SELECT p.layout_id, p.c AS u, q.c AS v FROM c p JOIN c q ON p.layout_id = q.layout_id AND q.j = p.j AND q.i = p.i + 1 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.layout_id = p.layout_id AND kind = 'v' AND abs(pos - p.x1) < 1e-6 AND lo < p.y1 - 1e-6 AND hi > p.y0 + 1e-6)
      UNION ALL SELECT p.layout_id, p.c, q.c FROM c p JOIN c q ON p.layout_id = q.layout_id AND q.i = p.i AND q.j = p.j + 1 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.layout_id = p.layout_id AND kind = 'h' AND abs(pos - p.y1) < 1e-6 AND lo < p.x1 - 1e-6 AND hi > p.x0 + 1e-6)),
    both_ways AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT layout_id, v, u FROM e),
    r AS (SELECT layout_id, c AS root, c FROM c UNION SELECT r.layout_id, r.root, b.v FROM r JOIN both_ways b ON b.layout_id = r.layout_id AND b.u = r.c),
    l AS (SELECT layout_id, c, min(root) AS root FROM r GROUP BY 1, 2),
    g AS (SELECT layout_id, (dense_rank() OVER (PARTITION BY layout_id ORDER BY root) - 1)::INT AS region, x0, y0, x1, y1 FROM l JOIN c USING (layout_id, c)),
    out AS (SELECT layout_id, region, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*)::INT AS cells FROM g GROUP BY 1, 2)
    """

ORACLE_SQL = {k: duck(v) for k, v in {
    "slice_grid": """SELECT group_id, pos, (i + 1)::INT AS tile, (floor((w - s) / 2) + i % 2 * tw)::BIGINT AS x, (floor((h - s) / 2) + i // 2 * th)::BIGINT AS y, tw::BIGINT AS w, th::BIGINT AS h
        FROM (SELECT *, least(w, h) AS s, floor(least(w, h) / 2) AS tw, floor(least(w, h) / 3) AS th FROM {items}), range(6) t(i) WHERE tw > 0 AND th > 0""",
    "stitch_layout": """WITH a AS (SELECT *, min(w) OVER (PARTITION BY group_id) AS c FROM {items}), b AS (SELECT *, greatest(1, floor(h * (c / w) + 0.5))::BIGINT AS l FROM a)
        SELECT group_id, pos, (10 + floor((max(c) OVER g - c) / 2))::BIGINT AS x, (10 + coalesce(sum(l + 4) OVER (PARTITION BY group_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS y, c::BIGINT AS w, l AS h, (max(c) OVER g + 20)::BIGINT AS canvas_w, (sum(l) OVER g + 4 * (count(*) OVER g - 1) + 20)::BIGINT AS canvas_h FROM b WINDOW g AS (PARTITION BY group_id)""",
    "stitch_layout_row": """SELECT group_id, pos, (5 + coalesce(sum(w + 3) OVER (PARTITION BY group_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x, (5 + floor((max(h) OVER g - h) / 2))::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, (sum(w) OVER g + 3 * (count(*) OVER g - 1) + 10)::BIGINT AS canvas_w, (max(h) OVER g + 10)::BIGINT AS canvas_h FROM {items} WINDOW g AS (PARTITION BY group_id)""",
    "grid_dims": """SELECT group_id, pos, CASE WHEN pos % 2 = 0 THEN s ELSE l END AS cols, CASE WHEN pos % 2 = 0 THEN l ELSE s END AS rows FROM (SELECT group_id, pos, CASE w % 17 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 8 THEN 4 WHEN 9 THEN 3 WHEN 16 THEN 4 ELSE 3 END AS l, CASE w % 17 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 3 WHEN 16 THEN 4 ELSE 2 END AS s FROM {items})""",
    "grid_regions": _REGIONS + "SELECT * FROM out",
    "spread_regions": _REGIONS + "SELECT * FROM out",
    "split_region": _REGIONS + "SELECT layout_id, 'v' AS kind, round(x0 + (x1 - x0) * k / 3, 6) AS pos, y0 AS lo, y1 AS hi FROM out, range(1, 3) t(k)",
    "remove_segment": f"""WITH s AS ({SEGMENTS_DUCK}), p AS (SELECT layout_id, kind, pos, lo + 0.25 AS lo, lo + 0.5 AS hi FROM s WHERE kind = 'v')
        SELECT s.layout_id, s.kind, s.pos, unnest(CASE WHEN p.pos IS NULL THEN [s.lo] ELSE [s.lo, p.hi] END) AS lo, unnest(CASE WHEN p.pos IS NULL THEN [s.hi] ELSE [p.lo, s.hi] END) AS hi FROM s LEFT JOIN p USING (layout_id, kind, pos)""",
    "collage_layout": f"""SELECT group_id, pos, region, CASE WHEN w % 3 = 0 THEN 'contain' ELSE 'cover' END AS fit, round(x0 * 960, 6) AS x, round(y0 * ch, 6) AS y, round(x1 * 960 - x0 * 960, 6) AS w, round(y1 * ch - y0 * ch, 6) AS h
        FROM (SELECT *, row_number() OVER g - 1 AS k, greatest(1, floor(960 * first(h / w) OVER g + 0.5)) AS ch FROM {{items}} WINDOW g AS (PARTITION BY group_id ORDER BY pos)) JOIN {_BOXES_DUCK} ON k = region""",
    "print_sheet": "SELECT id, size_key, i::INT AS cell, ((1500 - cols * w - (cols - 1) * 30) // 2 + i % cols * (w + 30))::BIGINT AS x, ((1050 - 2 * h - 30) // 2 + i // cols * (h + 30))::BIGINT AS y, w, h, (1500 - cols * w - (cols - 1) * 30) >= 0 AND 1050 - 2 * h - 30 >= 0 AS fits FROM (SELECT *, CASE WHEN h <= 531 THEN 4 ELSE 2 END AS cols FROM (SELECT c_custkey AS id, c_custkey % 7 AS n FROM customer) JOIN (VALUES " + ", ".join(f"({i}, '{k}', {w}, {h})" for i, (k, (w, h)) in enumerate(layout.PRINT_SIZES.items())) + ") t(n, size_key, w, h) USING (n)) JOIN range(8) r(i) ON i < cols * 2",
    "portrait_placement": "SELECT group_id, pos, round(pw, 6) AS w, round(ph, 6) AS h, round((295 - pw) / 2 + pos / 100 * 295, 6) AS x, round((413 - ph) / 2 - ph * 0.08::DOUBLE + 0.05::DOUBLE * 413, 6) AS y FROM (SELECT *, w * 10.0::DOUBLE * k AS pw, h * 10.0::DOUBLE * k AS ph FROM (SELECT *, 413 * 4.0::DOUBLE / 3 / (h * 10.0::DOUBLE) * (1 + pos / 10) AS k FROM {items}))",
    "default_layers": "SELECT group_id, pos, i::INT AS z, 501 AS w, floor(501 * h / w + 0.5)::BIGINT AS h, (i % 2 * 501)::INT AS x, (i // 2 * floor(700 / ceil((i + 1) / 2) + 0.5))::BIGINT AS y FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS i FROM {items})",
    "layer_size": """SELECT id, greatest(1, coalesce(nw, CASE WHEN free THEN w ELSE floor(w * nh / h + 0.5) END))::BIGINT AS w, greatest(1, coalesce(nh, CASE WHEN free THEN h ELSE floor(h * nw / w + 0.5) END))::BIGINT AS h
        FROM (SELECT group_id * 10 + pos AS id, w, h, pos % 2 = 0 AS free, CASE WHEN w % 3 <> 0 AND w % 5 <> 0 THEN h * 2 END AS nw, CASE WHEN w % 3 <> 1 AND w % 5 <> 0 THEN w * 3 END AS nh FROM {items}) WHERE nw IS NOT NULL OR nh IS NOT NULL""",
}.items()}
