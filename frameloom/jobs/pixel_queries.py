"""Registered queries over pixel tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.jobs.session import job
from frameloom.operators import blend, decode, permute, pixels, similar
from frameloom.sources.mapped import duck, table

C = F.col
SIDE = 8
PAIRS = "SELECT image_id AS pair_id, image_id AS inner_id, image_id + 1 AS cover_id FROM {pixels} WHERE x = 0 AND y = 0 AND image_id % 2 = 0"


def px(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pixels")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "embeddings").filter("vec_id % 2 = 0")
    return images.select(C("vec_id").alias("pair_id"), C("vec_id").alias("inner_id"), (C("vec_id") + 1).alias("cover_id"))


def both(spark: SparkSession, d: str) -> DataFrame:
    return blend.paired(px(spark, d), pairs(spark, d))


def layers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id")
    sets = v.select(F.floor(C("vec_id") / 3).alias("set_id"), (C("vec_id") % 3).cast("int").alias("n"), C("vec_id").alias("image_id"), (1 + C("vec_id") % 2).cast("int").alias("weight"))
    return blend.layer_ranges(sets)


def canvas_layers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id")
    return v.select(F.floor(C("vec_id") / 4).alias("canvas_id"), (C("vec_id") % 4).cast("int").alias("z"), C("vec_id").alias("image_id"), (C("vec_id") % 4 * 3).cast("int").alias("x"), (C("vec_id") % 3 * 2).cast("int").alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(0.0).alias("rot"), F.lit(1.0).alias("opacity"))


def opaque(p: DataFrame) -> DataFrame:
    return p.withColumn("a", F.lit(255))


def presets(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").filter("vec_id % 3 = 0")
    return v.select(C("vec_id").alias("image_id"), F.lit(60).alias("low"), (120 + C("vec_id") % 50).cast("int").alias("high"), F.lit(20).alias("contrast"))


def windowed(spark: SparkSession, d: str) -> DataFrame:
    p = px(spark, d)
    return p.withColumns({"low": (C("image_id") % 40 + 60).cast("int"), "high": (C("image_id") % 30 + 120).cast("int"), "contrast": (C("image_id") % 3 * 25).cast("int")})


def q_luma(spark, d):
    p = px(spark, d)
    return p.select("image_id", "x", "y", pixels.luma(C("r"), C("g"), C("b")).alias("luma"), pixels.luma(C("r"), C("g"), C("b"), stored=False).alias("rounded"))


def q_to_images(spark, d):
    return pixels.to_images(px(spark, d)).select("image_id", "w", "h", F.lower(F.hex("rgba")).alias("rgba"))


def q_image_round_trip(spark, d):
    return pixels.to_pixels(pixels.to_images(px(spark, d)))


def q_strip_alpha_lsb(spark, d):
    return pixels.strip_alpha_lsb(px(spark, d))


def q_channel_jitter(spark, d):
    return pixels.channel_jitter(px(spark, d), 3)


def q_gaussian_noise(spark, d):
    return pixels.gaussian_noise(px(spark, d), 0.05, 3)


def q_green_mix(spark, d):
    return pixels.green_mix(px(spark, d), 0.15)


def q_yuv_drift(spark, d):
    return pixels.yuv_drift(px(spark, d), 1)


def q_yuv_drift_rounds(spark, d):
    return pixels.yuv_drift(px(spark, d), 15)


def q_weather(spark, d):
    noise, green, ratio = pixels.PRESETS["low"]
    return pixels.weather(px(spark, d), "other", noise, green, ratio, SIDE, SIDE)


def corner_mark(p: DataFrame) -> DataFrame:
    return p.filter("image_id = 0 AND x < 3 AND y < 2").select("x", "y", "r", "g", "b", "a")


def q_weather_marked(spark, d):
    p = px(spark, d)
    noise, green, _ = pixels.PRESETS["high"]
    return pixels.weather(p, "other", noise, green, 0.75, SIDE, SIDE, 3, corner_mark(p), 3, 2)


def q_weather_classic(spark, d):
    return pixels.weather(px(spark, d), "classic", 0.02, 0.02, 1.5, SIDE, SIDE, 3)


def q_resize_three_quarters(spark, d):
    return pixels.resize(px(spark, d), SIDE, SIDE, 0.75)


def q_resize_grow(spark, d):
    return pixels.resize(px(spark, d), SIDE, SIDE, 1.5)


def q_composite_turned(spark, d):
    turned = canvas_layers(spark, d).withColumns({"rot": (C("z") * 90).cast("double"), "opacity": F.lit(1.0)})
    return blend.composite_layers(turned, opaque(px(spark, d)), SIDE, SIDE, 16, 12)


def q_composite_sheer(spark, d):
    sheer = canvas_layers(spark, d).withColumn("opacity", F.lit(0.5))
    return blend.composite_layers(sheer, opaque(px(spark, d)), SIDE, SIDE, 16, 12)


def q_fit_stretch(spark, d):
    t = table(spark, d, "items")
    return t.select("group_id", "pos", blend.fit_geometry(C("w"), C("h"), 40, 30, "stretch").alias("f")).select("group_id", "pos", "f.*")


def q_gilbert_curve_laws(spark, d):
    """Of the curve of each item size: its cells, different cells, where it starts, and its longest step."""
    sizes = table(spark, d, "items").select("w", "h")
    curve = permute.curves(sizes)
    w = Window.partitionBy("w", "h").orderBy("idx")
    step = F.greatest(F.abs(C("x") - F.lag("x").over(w)), F.abs(C("y") - F.lag("y").over(w)))
    laws = curve.withColumn("step", step).groupBy("w", "h").agg(F.count("*").alias("cells"), F.count_distinct(C("x") * 100 + C("y")).alias("places"), F.min_by(C("x") + C("y"), "idx").alias("start"), F.coalesce(F.max("step"), F.lit(0)).alias("step"))
    return sizes.groupBy("w", "h").agg(F.count("*").alias("items")).join(laws, ["w", "h"])


def q_overlay_corner(spark, d):
    p = px(spark, d)
    mark = corner_mark(p)
    return pixels.overlay_corner(p, mark, 3, 2, SIDE, SIDE)


def q_resize(spark, d):
    return pixels.resize(px(spark, d), SIDE, SIDE, 0.5)


def q_flatten_alpha(spark, d):
    return pixels.flatten_alpha(px(spark, d), 255)


def q_size_cap(spark, d):
    sized = table(spark, d, "items").withColumns({"bw": C("w") * 400, "bh": C("h") * 90})
    w, h = pixels.size_cap(C("bw"), C("bh"))
    return sized.select("group_id", "pos", w.alias("w"), h.alias("h"))


def q_thumb_factor(spark, d):
    return table(spark, d, "items").select("group_id", "pos", pixels.thumb_factor(C("w") * 40, C("h") * 30).alias("factor"))


def q_pixel_budget(spark, d):
    why = pixels.pixel_budget(C("w") * 100, C("h") * 50 - 50, C("w") % 30 + 1)
    return table(spark, d, "items").select(why.alias("why")).groupBy("why").agg(F.count("*").alias("n"))


def q_dual_blend(spark, d):
    b = both(spark, d)
    return blend.dual_blend(b, C("r"), C("cr"), 0.4, 0.5)


def q_stripe_interleave(spark, d):
    return blend.stripe_interleave(both(spark, d), -2, 2, True, 80, 120, False)


def q_stripe_mask(spark, d):
    return px(spark, d).select("image_id", "x", "y", blend.stripe_mask(C("x"), C("y"), 0, 1, False).alias("columns"), blend.stripe_mask(C("x"), C("y"), 3, 2, False).alias("slanted"))


def q_weighted_interleave(spark, d):
    return blend.weighted_interleave(layers(spark, d), px(spark, d))


def q_fit_geometry(spark, d):
    t = table(spark, d, "items")
    made = t.select("group_id", "pos", *(blend.fit_geometry(C("w"), C("h"), 40, 30, m).alias(m) for m in ("contain", "cover")))
    return made.select("group_id", "pos", *(F.round(f"{m}.{k}", 6).alias(f"{m}_{k}") for m, ks in (("contain", ("dx", "dy", "dw", "dh")), ("cover", ("sx", "sy", "sw", "sh"))) for k in ks))


def q_pad_cover(spark, d):
    return blend.pad_cover(px(spark, d), SIDE, SIDE, 12, 8, 255)


def q_composite_layers(spark, d):
    return blend.composite_layers(canvas_layers(spark, d), opaque(px(spark, d)), SIDE, SIDE, 16, 12)


def q_luma_histogram(spark, d):
    return decode.luma_histogram(px(spark, d))


def q_auto_window(spark, d):
    return decode.auto_window(decode.luma_histogram(px(spark, d)))


def q_window_decode(spark, d):
    return decode.window_decode(windowed(spark, d))


def q_diffuse_round(spark, d):
    return decode.diffuse_round(decode.window_decode(windowed(spark, d)))


def q_diffuse_fill(spark, d):
    images = pixels.to_known_images(decode.window_decode(windowed(spark, d)))
    return decode.diffuse_fill(images, 1).select("image_id", F.lower(F.hex("rgba")).alias("rgba"), "unfilled")


def q_diffuse_fill_rounds(spark, d):
    images = pixels.to_known_images(decode.window_decode(windowed(spark, d)))
    return decode.diffuse_fill(images).select("image_id", F.lower(F.hex("rgba")).alias("rgba"), "unfilled")


def q_diffuse_pixels(spark, d):
    return decode.diffuse_pixels(decode.window_decode(windowed(spark, d)))


def q_resize_images(spark, d):
    return pixels.to_pixels(pixels.resize_images(pixels.to_images(px(spark, d)), 0.75))


def q_gaussian_noise_images(spark, d):
    return pixels.to_pixels(pixels.gaussian_noise_images(pixels.to_images(px(spark, d)), 0.05, 3))


def q_decode_pipeline(spark, d):
    return decode.decode_pipeline(px(spark, d), presets(spark, d), 1)


def q_decode_pipeline_rounds(spark, d):
    return decode.decode_pipeline(px(spark, d), presets(spark, d))


def q_gilbert_curve(spark, d):
    return permute.curves(table(spark, d, "items").select((C("w") % 12 + 1).alias("w"), (C("h") % 12 + 1).alias("h")))


def q_scramble_round_trip(spark, d):
    p = px(spark, d)
    curve = permute.curves(spark.range(1).select(F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h")))
    return permute.scramble_pixels(permute.scramble_pixels(p, curve, SIDE, SIDE), curve, SIDE, SIDE, back=True)


def q_scramble_block(spark, d):
    once = permute.scramble(pixels.to_images(px(spark, d)), 3)
    return pixels.to_pixels(permute.scramble(once, 3, back=True))


def with_jittered(spark: SparkSession, d: str) -> DataFrame:
    """Every image under twice its number, and beside each one a jittered copy."""
    p = px(spark, d)
    return p.withColumn("image_id", C("image_id") * 2).unionByName(pixels.channel_jitter(p, 3).withColumn("image_id", C("image_id") * 2 + 1))


def q_jitter_duplicates(spark, d):
    return similar.similar_pictures(similar.perceptual_hashes(pixels.to_images(with_jittered(spark, d))))


QUERIES = {k[2:]: job(v) for k, v in list(globals().items()) if k.startswith("q_")}

_STORE = "greatest(0, least(255, round_even({0}, 0)))::INT"
_LUMA = "r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE"


def _store(e: str) -> str:
    return _STORE.format(e)


def _clamp(e: str) -> str:
    return f"greatest(0, least(255, {e}))::INT"


def _up(e: str) -> str:
    return f"floor(({e}) + 0.5)"


_BOTH = "(SELECT p.pair_id, i.x, i.y, i.r, i.g, i.b, i.a, c.r AS cr, c.g AS cg, c.b AS cb, c.a AS ca FROM (" + PAIRS + ") p JOIN {pixels} i ON i.image_id = p.inner_id JOIN {pixels} c ON c.image_id = p.cover_id AND c.x = i.x AND c.y = i.y)"
_WINDOWED = "(SELECT *, (image_id % 40 + 60)::INT AS low, (image_id % 30 + 120)::INT AS high, (image_id % 3 * 25)::INT AS contrast FROM {pixels})"


def _decoded(source: str) -> str:
    inside = f"(high > low AND {_store(_LUMA)} BETWEEN low AND high)"

    def tone(c: str) -> str:
        s = _clamp(_up(f"({c} - low) * 255.0::DOUBLE / nullif(high - low, 0)"))
        return f"CASE WHEN {inside} THEN CASE WHEN contrast <> 0 THEN {_clamp(_up(f'({s} - 128) * contrast / 50.0::DOUBLE + 128'))} ELSE {s} END ELSE 0 END::INT AS {c}"

    return f"(SELECT image_id, x, y, {', '.join(map(tone, 'rgb'))}, CASE WHEN {inside} THEN a ELSE 255 END::INT AS a, NOT {inside} AS is_fill FROM {source})"


def _diffused(source: str) -> str:
    near = ", ".join(f"({dx}, {dy}, {k}::DOUBLE)" for dx, dy, k in decode.OFFSETS)
    means = ", ".join(f"{_store(f'round(sum(k.{c} * o.k) / sum(o.k), 6)')} AS m{c}" for c in "rgba")
    return f"""WITH d AS MATERIALIZED {source}, o(dx, dy, k) AS (VALUES {near}),
        m AS (SELECT f.image_id, f.x, f.y, {means} FROM d f JOIN o ON true JOIN d k ON k.image_id = f.image_id AND k.x = f.x + o.dx AND k.y = f.y + o.dy WHERE f.is_fill AND NOT k.is_fill GROUP BY ALL)
        SELECT d.image_id, d.x, d.y, {', '.join(f'coalesce(m{c}, {c})::INT AS {c}' for c in 'rgba')}, is_fill AND mr IS NULL AS is_fill FROM d LEFT JOIN m ON m.image_id = d.image_id AND m.x = d.x AND m.y = d.y"""


def _hashed(n: str, seed: int = 3) -> str:
    return f"((image_id * 7919 + x * 104729 + y * 1299709 + {n} * 15485863 + {seed} * 49979687) % 2147483647)"


def _uniform(n: int) -> str:
    return f"(({_hashed(str(n))} * 48271 % 2147483647 + 1) / 2147483648.0::DOUBLE)"


def _noised(source: str, k: float, seed: int = 3) -> str:
    normal = lambda n: f"(sqrt(-2 * ln({_uniform(2 * n)})) * cos(6.283185307179586::DOUBLE * {_uniform(2 * n + 1)}))"
    return "(SELECT image_id, x, y, " + ", ".join(_clamp(_up(f"{1 - k}::DOUBLE * {c} + {k}::DOUBLE * {normal(n)} * 255")) + f" AS {c}" for n, c in enumerate("rgb")) + f", a FROM {source})"


def _greened(source: str, k: float) -> str:
    return "(SELECT image_id, x, y, " + ", ".join(_clamp(_up(f"{c} * {1 - k}::DOUBLE + {255 * k if c == 'g' else 0.0}::DOUBLE - {128 * k}::DOUBLE + {32 * k if c == 'g' else 0.0}::DOUBLE")) + f" AS {c}" for c in "rgb") + f", a FROM {source})"


def _drifted(source: str) -> str:
    return "(SELECT image_id, x, y, " + ", ".join(_clamp(f"floor((65536 * yy + {e}) / 65536.0::DOUBLE)") + f" AS {c}" for c, e in (("r", "116130 * u"), ("g", "-22553 * u - 46802 * v"), ("b", "91881 * v"))) + f", a FROM ({_DRIFT.replace('{pixels}', source)}))"


def _resized(source: str, new: int) -> str:
    part = lambda c: f"(least(({c} + 1) * {new}, (t{c} + 1) * 8) - greatest({c} * {new}, t{c} * 8))"
    return f"SELECT image_id, tx::INT AS x, ty::INT AS y, " + ", ".join(_store(f"sum({c} * k) / sum(k)") + f" AS {c}" for c in "rgba") + f" FROM (SELECT *, {part('x')} * {part('y')} AS k FROM {source}, range({new}) u(tx), range({new}) v(ty) WHERE {part('x')} > 0 AND {part('y')} > 0) GROUP BY ALL"


_MARKED = "(SELECT p.image_id, p.x, p.y, " + ", ".join(f"CASE WHEN m.a IS NULL THEN p.{c} ELSE {_store(f'm.{c} * m.a / 255 + p.{c} * (255 - m.a) / 255')} END::INT AS {c}" for c in "rgb") + ", greatest(p.a, coalesce(m.a, 0)) AS a FROM {pixels} p LEFT JOIN {pixels} m ON m.image_id = 0 AND m.x < 3 AND m.y < 2 AND p.x = m.x + 5 AND p.y = m.y + 6)"
_LAID = "(SELECT image_id // 4 AS canvas_id, image_id % 4 AS z, CASE image_id % 4 WHEN 0 THEN x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x ELSE y END + image_id % 4 * 3 AS tx, CASE image_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 7 - y ELSE 7 - x END + image_id % 3 * 2 AS ty, r, g, b FROM {pixels})"
#: A round reaches two pixels further, so four rounds are the end of any fill of 8 by 8.
ROUNDS = 4
_FLOORS = "floor(({0}) / 256.0::DOUBLE)::BIGINT - 1"
_DRIFT = "SELECT image_id, x, y, a, greatest(0, least(255, " + _FLOORS.format("150 * r + 77 * g + 29 * b") + ")) AS yy, greatest(-128, least(127, " + _FLOORS.format("-85 * r - 43 * g + 128 * b") + ")) AS u, greatest(-128, least(127, " + _FLOORS.format("-107 * r + 128 * g - 21 * b") + ")) AS v FROM {pixels}"

_WINDOW_SQL = f"""(SELECT p.*, CASE WHEN p.image_id % 3 = 0 THEN 60 ELSE 0 END AS low, CASE WHEN p.image_id % 3 = 0 THEN (120 + p.image_id % 50)::INT ELSE w.high END AS high, CASE WHEN p.image_id % 3 = 0 THEN 20 ELSE 0 END AS contrast FROM {{pixels}} p JOIN
        (SELECT image_id, min(luma) AS high FROM (SELECT image_id, luma, sum(n) OVER (PARTITION BY image_id ORDER BY luma) AS cum, sum(n) OVER (PARTITION BY image_id) AS total FROM (SELECT image_id, {_up(_LUMA)}::INT AS luma, count(*) AS n FROM {{pixels}} GROUP BY 1, 2)) WHERE cum * 2 >= total GROUP BY 1) w USING (image_id))"""


def _to_the_end(source: str) -> str:
    for _ in range(ROUNDS):
        source = f"({_diffused(source)})"
    return source


_JITTERED = "SELECT image_id, x, y, " + ", ".join(_clamp(_clamp(f"{c} + {_hashed(str(k))} * 48271 % 2147483647 % 5 - 2") + f" + ((image_id * 7919 + {k} * 15485863 + 3 * 49979687) % 2147483647) * 48271 % 2147483647 % 3 - 1") + f" AS {c}" for k, c in enumerate("rgb")) + ", a FROM {pixels}"
#: Hashes from their definition, then all pairs of different hashes.
_SIMILAR = f"""WITH RECURSIVE p AS (SELECT image_id * 2 AS image_id, x, y, r, g, b FROM {{pixels}} UNION ALL SELECT image_id * 2 + 1, x, y, r, g, b FROM ({_JITTERED})),
    s AS (SELECT u, v, x, y, CASE WHEN (bit_count(u & x) + bit_count(v & y)) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT range AS u FROM range(8)), (SELECT range AS v FROM range(8)), (SELECT range AS x FROM range(8)), (SELECT range AS y FROM range(8))),
    t AS (SELECT image_id, u, v, sum(r * s) AS r, sum(g * s) AS g, sum(b * s) AS b FROM p JOIN s ON p.x = s.x AND p.y = s.y GROUP BY ALL),
    n AS (SELECT image_id, c * 4 + (v * 8 + u) // 16 AS band, sum(CASE WHEN value > 0 THEN 1 << ((v * 8 + u) % 16)::INT ELSE 0 END)::BIGINT AS bits FROM (SELECT image_id, u, v, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS value FROM t) GROUP BY ALL),
    h AS (SELECT image_id, string_agg(printf('%04x', bits), '' ORDER BY band) AS hash, list(bits ORDER BY band) AS bands FROM n GROUP BY image_id),
    g AS (SELECT hash, min(image_id) AS id, count(*) AS n, any_value(bands) AS bands FROM h GROUP BY hash),
    e AS (SELECT a.id AS a, b.id AS b, b.n FROM g a JOIN g b ON a.id <> b.id AND list_sum(list_transform(list_zip(a.bands, b.bands), lambda z : bit_count(xor(z[1], z[2])))) <= 10),
    reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
    SELECT image_id, h.hash, class_id, (g.n - 1 + coalesce(near, 0))::BIGINT AS links FROM h JOIN g USING (hash) JOIN (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a) USING (id) LEFT JOIN (SELECT a AS id, sum(n) AS near FROM e GROUP BY a) USING (id)"""

ORACLE_SQL = {k: duck(v) for k, v in {
    "jitter_duplicates": _SIMILAR,
    "diffuse_fill_rounds": f"SELECT image_id, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x) AS rgba, sum(is_fill::INT)::INT AS unfilled FROM {_to_the_end(_decoded(_WINDOWED))} GROUP BY image_id",
    "decode_pipeline_rounds": f"SELECT * FROM {_to_the_end(_decoded(_WINDOW_SQL))}",
    "weather_marked": _resized(_greened(_noised(_MARKED, 0.05), 0.15), 6),
    "weather_classic": _resized(_drifted(_drifted(_noised("{pixels}", 0.02))), 12),
    "resize_three_quarters": _resized("{pixels}", 6),
    "resize_grow": _resized("{pixels}", 12),
    "composite_turned": f"SELECT canvas_id, tx::INT AS x, ty::INT AS y, max_by(r, z) AS r, max_by(g, z) AS g, max_by(b, z) AS b FROM {_LAID} WHERE tx < 16 AND ty < 12 GROUP BY ALL",
    "composite_sheer": "SELECT canvas_id, x, y, " + ", ".join(_store(f"list_reduce(list_prepend(255.0::DOUBLE, list({c}::DOUBLE ORDER BY z)), lambda s, v : v * 0.5::DOUBLE + s * 0.5::DOUBLE)") + f" AS {c}" for c in "rgb") + " FROM (SELECT image_id // 4 AS canvas_id, image_id % 4 AS z, (x + image_id % 4 * 3)::INT AS x, (y + image_id % 3 * 2)::INT AS y, r, g, b FROM {pixels}) WHERE x < 16 AND y < 12 GROUP BY canvas_id, x, y",
    "fit_stretch": "SELECT group_id, pos, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, w::DOUBLE AS sw, h::DOUBLE AS sh, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 40.0::DOUBLE AS dw, 30.0::DOUBLE AS dh FROM {items}",
    "gilbert_curve_laws": "SELECT w, h, count(*) AS items, (w * h)::BIGINT AS cells, (w * h)::BIGINT AS places, 0 AS start, CASE WHEN w * h > 1 THEN 1 ELSE 0 END AS step FROM {items} GROUP BY w, h",
    "luma": f"SELECT image_id, x, y, {_store(_LUMA)} AS luma, {_up(_LUMA)}::INT AS rounded FROM {{pixels}}",
    "to_images": "SELECT image_id, 8 AS w, 8 AS h, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x) AS rgba FROM {pixels} GROUP BY image_id",
    "image_round_trip": "SELECT image_id, x, y, r, g, b, a FROM {pixels}",
    "strip_alpha_lsb": "SELECT image_id, x, y, CASE WHEN a < 2 THEN 255 ELSE r END AS r, CASE WHEN a < 2 THEN 255 ELSE g END AS g, CASE WHEN a < 2 THEN 255 ELSE b END AS b, a - a % 2 AS a, a % 2 = 1 OR (a < 2 AND (r <> 255 OR g <> 255 OR b <> 255)) AS changed FROM {pixels}",
    "channel_jitter": "SELECT image_id, x, y, " + ", ".join(_clamp(_clamp(f"{c} + {_hashed(str(k))} * 48271 % 2147483647 % 5 - 2") + f" + ((image_id * 7919 + {k} * 15485863 + 3 * 49979687) % 2147483647) * 48271 % 2147483647 % 3 - 1") + f" AS {c}" for k, c in enumerate("rgb")) + ", a FROM {pixels}",
    "gaussian_noise": "SELECT image_id, x, y, " + ", ".join(_clamp(_up(f"0.95::DOUBLE * {c} + 0.05::DOUBLE * (sqrt(-2 * ln({_uniform(2 * k)})) * cos(6.283185307179586::DOUBLE * {_uniform(2 * k + 1)})) * 255")) + f" AS {c}" for k, c in enumerate("rgb")) + ", a FROM {pixels}",
    "green_mix": "SELECT image_id, x, y, " + ", ".join(_clamp(_up(f"{c} * 0.85::DOUBLE + {255 * 0.15 if c == 'g' else 0.0}::DOUBLE - 19.2::DOUBLE + {32 * 0.15 if c == 'g' else 0.0}::DOUBLE")) + f" AS {c}" for c in "rgb") + ", a FROM {pixels}",
    "yuv_drift": "SELECT image_id, x, y, " + ", ".join(_clamp(f"floor((65536 * yy + {e}) / 65536.0::DOUBLE)") + f" AS {c}" for c, e in (("r", "116130 * u"), ("g", "-22553 * u - 46802 * v"), ("b", "91881 * v"))) + f", a FROM ({_DRIFT})",
    "yuv_drift_rounds": f"""WITH RECURSIVE d AS (SELECT image_id, x, y, r, g, b, a, 0 AS n FROM {{pixels}} UNION ALL
        SELECT image_id, x, y, {', '.join(_clamp(f'floor((65536 * yy + {e}) / 65536.0::DOUBLE)') for e in ('116130 * u', '-22553 * u - 46802 * v', '91881 * v'))}, a, n + 1
        FROM ({_DRIFT.replace('x, y, a, ', 'x, y, a, n, ').replace('{pixels}', 'd')}) WHERE n < 15) SELECT image_id, x, y, r, g, b, a FROM d WHERE n = 15""",
    "overlay_corner": "SELECT p.image_id, p.x, p.y, " + ", ".join(f"CASE WHEN m.a IS NULL THEN p.{c} ELSE {_store(f'm.{c} * m.a / 255 + p.{c} * (255 - m.a) / 255')} END::INT AS {c}" for c in "rgb") + ", greatest(p.a, coalesce(m.a, 0)) AS a FROM {pixels} p LEFT JOIN {pixels} m ON m.image_id = 0 AND m.x < 3 AND m.y < 2 AND p.x = m.x + 5 AND p.y = m.y + 6",
    "resize": "SELECT image_id, (x // 2)::INT AS x, (y // 2)::INT AS y, " + ", ".join(f"{_store(f'avg({c})')} AS {c}" for c in "rgba") + " FROM {pixels} GROUP BY 1, 2, 3",
    "flatten_alpha": "SELECT image_id, x, y, " + ", ".join(f"round_even({c} * a / 255 + 255 * (255 - a) / 255, 0)::INT AS {c}" for c in "rgb") + " FROM {pixels}",
    "size_cap": "SELECT group_id, pos, greatest(1, floor(bw * s + 0.5))::BIGINT AS w, greatest(1, floor(bh * s + 0.5))::BIGINT AS h FROM (SELECT *, least(sqrt(2e7::DOUBLE / (bw * bh)), 6000.0::DOUBLE / bw, 6000.0::DOUBLE / bh, 1.0::DOUBLE) AS s FROM (SELECT group_id, pos, w * 400 AS bw, h * 90 AS bh FROM {items}))",
    "thumb_factor": """SELECT group_id, pos, CASE WHEN w * 40 > 120 OR h * 30 > 120 THEN pow(2, len(list_filter(range(0, 21), lambda k: floor(floor(w * 40 / 2) / pow(2, k)) >= 120 AND floor(floor(h * 30 / 2) / pow(2, k)) >= 120)))::INT ELSE 1 END AS factor FROM {items}""",
    "pixel_budget": "SELECT CASE WHEN w * 100 <= 0 OR h * 50 - 50 <= 0 THEN 'empty' WHEN w * 100 * (h * 50 - 50) > 8000000 THEN 'frame' WHEN w::BIGINT * 100 * (h * 50 - 50) * (w % 30 + 1) > 300000000 THEN 'animation' END AS why, count(*) AS n FROM {items} GROUP BY 1",
    "dual_blend": f"""SELECT pair_id, x, y, CASE WHEN x = 0 AND y = 0 THEN 114 ELSE {_clamp('CASE WHEN a2 > 0 THEN floor(li * 255 / a2) ELSE 0 END')} END::INT AS r, CASE WHEN x = 0 AND y = 0 THEN 114 ELSE {_clamp('CASE WHEN a2 > 0 THEN floor(li * 255 / a2) ELSE 0 END')} END::INT AS g, CASE WHEN x = 0 AND y = 0 THEN 114 ELSE {_clamp('CASE WHEN a2 > 0 THEN floor(li * 255 / a2) ELSE 0 END')} END::INT AS b, CASE WHEN x = 0 AND y = 0 THEN 255 ELSE {_clamp('a2')} END::INT AS a
        FROM (SELECT *, 255 - lc + li AS a2 FROM (SELECT pair_id, x, y, floor(r * 0.4::DOUBLE) AS li, floor(255 - (255 - cr) * 0.5::DOUBLE) AS lc FROM {_BOTH}))""",
    "stripe_interleave": "SELECT pair_id, x, y, " + ", ".join(f"CASE WHEN m THEN floor(c{c} * 135 / 255 + 120) ELSE floor({c} * 80 / 255) END::INT AS {c}" for c in "rgb") + f", CASE WHEN m THEN ca ELSE a END AS a FROM (SELECT *, (y / 2.0::DOUBLE + x) % 3 < 2 AS m FROM {_BOTH})",
    "stripe_mask": "SELECT image_id, x, y, x % 2 < 1 AS columns, (x / 3.0::DOUBLE + y) % 3 < 2 AS slanted FROM {pixels}",
    "weighted_interleave": """WITH l AS (SELECT vec_id // 3 AS set_id, (vec_id % 3)::INT AS n, vec_id AS image_id, (1 + vec_id % 2)::INT AS weight FROM embeddings),
        s AS (SELECT *, least(254, n * 29) AS lo, least(255, least(254, n * 29) + 24) AS hi, sum(weight) OVER (PARTITION BY set_id ORDER BY n) AS c1, sum(weight) OVER (PARTITION BY set_id) AS total FROM l)
        SELECT set_id, x, y, n, """ + ", ".join(f"CASE WHEN lo >= hi THEN lo ELSE floor(greatest(lo, least(p.{c} * (hi - lo) / 255 + lo, hi))) END::INT AS {c}" for c in "rgb") + ", a FROM s JOIN {pixels} p USING (image_id) WHERE (x + y) % total >= c1 - weight AND (x + y) % total < c1",
    "fit_geometry": """SELECT group_id, pos, round((40 - w * k) / 2, 6) AS contain_dx, round((30 - h * k) / 2, 6) AS contain_dy, round(w * k, 6) AS contain_dw, round(h * k, 6) AS contain_dh, round((w - 40 / f) / 2, 6) AS cover_sx, round((h - 30 / f) / 2, 6) AS cover_sy, round(40 / f, 6) AS cover_sw, round(30 / f, 6) AS cover_sh
        FROM (SELECT *, least(40 / w, 30 / h) AS k, greatest(40 / w, 30 / h) AS f FROM (SELECT group_id, pos, w::DOUBLE AS w, h::DOUBLE AS h FROM {items}))""",
    "pad_cover": """SELECT g.image_id, g.x, g.y, coalesce(r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(b, 255) AS b, coalesce(a, 255) AS a
        FROM (SELECT vec_id AS image_id, (i % 12)::INT AS x, (i // 12)::INT AS y FROM embeddings, range(96) t(i)) g LEFT JOIN {pixels} p ON p.image_id = g.image_id AND p.x = g.x - 2 AND p.y = g.y""",
    "composite_layers": """SELECT canvas_id, tx AS x, ty AS y, max_by(r, z) AS r, max_by(g, z) AS g, max_by(b, z) AS b FROM (SELECT image_id // 4 AS canvas_id, image_id % 4 AS z, (x + image_id % 4 * 3)::INT AS tx, (y + image_id % 3 * 2)::INT AS ty, r, g, b FROM {pixels}) WHERE tx < 16 AND ty < 12 GROUP BY 1, 2, 3""",
    "luma_histogram": f"SELECT image_id, {_up(_LUMA)}::INT AS luma, count(*) AS n FROM {{pixels}} GROUP BY 1, 2",
    "auto_window": f"""SELECT image_id, 0 AS low, min(luma) AS high FROM (SELECT image_id, luma, sum(n) OVER (PARTITION BY image_id ORDER BY luma) AS cum, sum(n) OVER (PARTITION BY image_id) AS total FROM (SELECT image_id, {_up(_LUMA)}::INT AS luma, count(*) AS n FROM {{pixels}} GROUP BY 1, 2)) WHERE cum * 2 >= total GROUP BY 1""",
    "window_decode": f"SELECT * FROM {_decoded(_WINDOWED)}",
    "diffuse_round": _diffused(_decoded(_WINDOWED)),
    "diffuse_fill": f"SELECT image_id, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x) AS rgba, sum(is_fill::INT)::INT AS unfilled FROM ({_diffused(_decoded(_WINDOWED))}) GROUP BY image_id",
    "decode_pipeline": _diffused(_decoded(f"""(SELECT p.*, CASE WHEN p.image_id % 3 = 0 THEN 60 ELSE 0 END AS low, CASE WHEN p.image_id % 3 = 0 THEN (120 + p.image_id % 50)::INT ELSE w.high END AS high, CASE WHEN p.image_id % 3 = 0 THEN 20 ELSE 0 END AS contrast FROM {{pixels}} p JOIN
        (SELECT image_id, min(luma) AS high FROM (SELECT image_id, luma, sum(n) OVER (PARTITION BY image_id ORDER BY luma) AS cum, sum(n) OVER (PARTITION BY image_id) AS total FROM (SELECT image_id, {_up(_LUMA)}::INT AS luma, count(*) AS n FROM {{pixels}} GROUP BY 1, 2)) WHERE cum * 2 >= total GROUP BY 1) w USING (image_id))""")),
    "scramble_round_trip": "SELECT image_id, x, y, r, g, b, a FROM {pixels}",
    "scramble_block": "SELECT image_id, x, y, r, g, b, a FROM {pixels}",
    "weather": "SELECT image_id, x, y, " + ", ".join(_clamp(_up(f"{c} * 0.95::DOUBLE + {255 * 0.05 if c == 'g' else 0.0}::DOUBLE - 6.4::DOUBLE + {32 * 0.05 if c == 'g' else 0.0}::DOUBLE")) + f" AS {c}" for c in "rgb") + ", a FROM {pixels}",
}.items()}
ORACLE_SQL |= {
    "diffuse_pixels": duck(f"SELECT * FROM {_to_the_end(_decoded(_WINDOWED))}"),
    "resize_images": ORACLE_SQL["resize_three_quarters"],
    "gaussian_noise_images": ORACLE_SQL["gaussian_noise"],
}
