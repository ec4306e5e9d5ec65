"""Registered queries over containers and metadata, with their SQL where SQL can say the same.

Queries over bytes pack the mapped images into PNG and APNG files first, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.jobs import catalog_queries
from frameloom.jobs.pixel_queries import SIDE, px
from frameloom.jobs.session import job
from frameloom.operators import catalog, container, digest, metadata, pixels
from frameloom.sources import files, loose, table_functions
from frameloom.sources.mapped import duck, table
from frameloom.sources.scratch import materialize, scratch_path

C = F.col
TIFF_FIELDS = [("ifd0", 0x010F, 2, "Maker"), ("ifd0", 0x0132, 2, "2024:05:06 07:08:09"), ("exif", 0x829A, 5, [(1, 125)]), ("gps", 0x0001, 2, "S"), ("gps", 0x0002, 5, [(33, 1), (51, 1), (3050, 100)]), ("gps", 0x0003, 2, "W"), ("gps", 0x0004, 5, [(70, 1), (40, 1), (1225, 100)])]


def marked(spark, d) -> DataFrame:
    return table(spark, d, "marked_chunks")


def pngs(spark, d) -> DataFrame:
    """files(path, content): every image as a PNG."""
    return container.png_of_images(pixels.to_images(px(spark, d)))


def disguised(spark, d) -> DataFrame:
    """files(path, content): each image of even number hides the next one, or the next two with a delay."""
    p = pngs(spark, d)
    n = p.select(C("path").cast("long").alias("n"), "content")
    owner = n.select("content", (C("n") - C("n") % 3).alias("path"), (C("n") % 3).alias("k"), (C("n") % 3 * 40).cast("int").alias("ms"))
    grouped = owner.groupBy("path").agg(F.max(F.when(C("k") == 0, C("content"))).alias("cover"), F.transform(F.array_sort(F.collect_list(F.when(C("k") > 0, F.struct("k", C("content").alias("png"), C("ms").alias("delay_ms"))))), lambda s: F.struct(s["png"].alias("png"), s["delay_ms"].alias("delay_ms"))).alias("frames"))
    grouped = grouped.filter(F.size("frames") > 0)
    still = grouped.filter("path % 2 = 0").withColumn("frames", F.slice("frames", 1, 1))
    return container.compose(still, "STATIC").unionByName(container.compose(grouped.filter("path % 2 = 1"), "ANIMATED"))


def q_inspect_disguise(spark, d):
    return container.inspect_disguise(marked(spark, d))


def q_frame_pieces(spark, d):
    return container.frame_pieces(table(spark, d, "chunks"))


def q_count_hidden_frames(spark, d):
    return container.count_hidden_frames(table(spark, d, "frames"))


def q_restore_plan(spark, d):
    return container.restore_plan(container.inspect_disguise(marked(spark, d)), container.count_hidden_frames(table(spark, d, "frames")))


def q_frame_delay_ms(spark, d):
    f = table(spark, d, "frames")
    return f.select("path", "frame_no", *(container.frame_delay_ms(C("delay_num"), C("delay_den"), C("has_ctl"), m).alias(m) for m in ("web", "java")))


def q_png_chunks(spark, d):
    rows = container.png_chunks(pngs(spark, d))
    known = F.when(C("type") != "IDAT", C("length"))  # what deflate makes is no concern here
    return rows.select(C("path").cast("long").alias("path"), "chunk_no", "type", known.alias("length"), container.chunk_crc_ok(C("type"), C("payload"), C("crc")).alias("crc_ok"))


def q_image_header(spark, d):
    return container.image_header(container.png_chunks(pngs(spark, d), ("IHDR",)))


def q_frame_control(spark, d):
    frames = container.frame_control(container.frame_groups(container.png_chunks(disguised(spark, d))))
    return frames.select("path", "frame_no", F.size("pieces").alias("pieces"), "seq", "w", "h", "delay_num", "delay_den", "dispose", "blend")


def q_trailing_bytes(spark, d):
    p = pngs(spark, d)
    longer = p.select("path", F.concat("content", F.encode(F.repeat(F.lit("x"), (C("path").cast("int") % 5)), "UTF-8")).alias("content"))
    plain = p.select("path", F.upper(F.md5("content")).alias("md5"))
    return container.trailing_bytes(longer).join(plain, "path").select("path", "tail", (C("payload_md5") == C("md5")).alias("same_payload"))


def q_restore(spark, d):
    got = container.restore(disguised(spark, d)).withColumn("n", C("path").cast("long") + C("frame_no"))
    plain = pngs(spark, d).select(C("path").cast("long").alias("n"), "content")
    return got.join(plain, "n").select("path", "frame_no", "is_anim", "delay_ms", (C("png") == C("content")).alias("as_hidden"))


def q_restore_chunks(spark, d):
    chunks = materialize(container.png_chunks(disguised(spark, d)), "chunks")
    got = container.restore_chunks(chunks).withColumn("n", C("path").cast("long") + C("frame_no"))
    plain = pngs(spark, d).select(C("path").cast("long").alias("n"), "content")
    return got.join(plain, "n").select("path", "frame_no", "is_anim", "delay_ms", (C("png") == C("content")).alias("as_hidden"))


def q_extract_cover(spark, d):
    return container.extract_cover(disguised(spark, d)).join(pngs(spark, d), "path").select("path", (C("cover") == C("content")).alias("as_before"))


def q_metadata_chunks(spark, d):
    return metadata.metadata_chunks(metadata.write_exif(pngs(spark, d), TIFF_FIELDS)).select("path", "type")


def q_number_frames(spark, d):
    return container.numbered(table(spark, d, "chunks")).select("path", "chunk_no", C("frame_no").cast("int").alias("frame_no"))


def q_gps_decimal(spark, d):
    t = table(spark, d, "tags")
    refs = t.filter("name IN ('GPSLatitude', 'GPSLongitude')").select("path", F.concat("name", F.lit("Ref")).alias("name"), "value", F.lit(None).cast("array<double>").alias("nums"))
    return metadata.gps_decimal(t.select("path", "name", "value", "nums").unionByName(refs))


def q_sensitive_tags(spark, d):
    return metadata.sensitive_tags(table(spark, d, "tags")).groupBy("name").agg(F.count("*").alias("n"), F.max("path").alias("last"))


def q_has_hidden_info(spark, d):
    files = table(spark, d, "orders").select(C("o_custkey").alias("path")).distinct()
    return metadata.has_hidden_info(files, table(spark, d, "tags").filter("name = 'OwnerName' AND path % 3 = 0"), table(spark, d, "frames").select("path"))


def q_is_generation_params(spark, d):
    return table(spark, d, "text_chunks").select("path", "chunk_no", metadata.is_generation_params(C("keyword"), C("value")).alias("is_important"))


def q_text_export(spark, d):
    return metadata.text_export(table(spark, d, "text_chunks")).select("path", "chunk_no", "file_name", F.length("value").alias("chars"))


def q_write_exif(spark, d):
    tags = metadata.exif_tags(metadata.write_exif(pngs(spark, d), TIFF_FIELDS))
    return tags.select(C("path").cast("long").alias("path"), "ifd", "name", "value", F.element_at(F.coalesce("nums", F.array(F.lit(-1.0))), 1).alias("first"))


def q_gps_of_files(spark, d):
    return metadata.gps_decimal(metadata.exif_tags(metadata.write_exif(pngs(spark, d), TIFF_FIELDS)))


def q_strip_metadata(spark, d):
    p = pngs(spark, d)
    stripped = metadata.strip_metadata(metadata.write_exif(p, TIFF_FIELDS))
    both = stripped.join(p.select("path", C("content").alias("plain")), "path")
    return both.select("path", (C("content") == C("plain")).alias("as_before"))


def q_text_chunks(spark, d):
    t = table(spark, d, "text_chunks").filter("keyword IS NOT NULL AND value IS NOT NULL")
    # Conversations are dealt over the images, whose numbers run from 0, so that none is without a file.
    image = F.regexp_replace("path", "conv/", "").cast("long") % table(spark, d, "embeddings").count()
    meta = t.select(image.cast("string").alias("path"), "chunk_no", F.lit("iTXt").alias("type"), F.concat(F.encode("keyword", "ISO-8859-1"), F.unhex(F.lit("0000000000")), F.encode("value", "UTF-8")).alias("payload"))
    files = metadata.append_metadata(pngs(spark, d), meta)
    return metadata.text_chunks(files).select("path", "keyword", F.md5("value").alias("value_md5"), "is_important")


def q_exif_fields(spark, d):
    e = table(spark, d, "exposures").filter("t > 0")
    return e.select("id", *(v.alias(k) for k, v in metadata.exif_fields(C("t"), C("f"), C("focal")).items()))


def q_decimal_to_dms(spark, d):
    e = table(spark, d, "exposures")
    return e.select("id", metadata.decimal_to_dms(C("lat"), "N", "S").alias("p")).select("id", "p.*")


def q_parse_exposure(spark, d):
    e = table(spark, d, "exposures").withColumn("seconds", metadata.parse_exposure(C("raw")))
    return e.filter(metadata.valid_place(C("lat"), C("lon"))).select("id", "seconds")


def q_decode_preset(spark, d):
    return table(spark, d, "presets").select("id", metadata.decode_preset(C("str")).alias("p")).select("id", "p.*")


def exported(spark, d) -> str:
    """A folder of loose PNG files, one for each image."""
    folder = scratch_path(spark, "pictures")
    loose.write_loose(pngs(spark, d).withColumn("name", F.concat("path", F.lit(".png"))), folder)
    return folder


def q_read_files(spark, d):
    got = files.read_files(spark, exported(spark, d), "*.png")
    header = container.image_header(container.png_chunks(got, ("IHDR",)))
    kind = catalog.sniff_type(C("content"))
    return got.select("path", "name", kind.alias("kind"), (C("length") == F.length("content")).alias("whole")).join(header, "path").select(F.split("name", r"\.")[0].cast("long").alias("image_id"), "kind", "whole", "width", "height")


def q_read_pixels(spark, d):
    got = files.read_pixels(spark, exported(spark, d))
    return got.select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("image_id"), "w", "h", F.lower(F.hex("rgba")).alias("rgba"))


def q_write_files(spark, d):
    folder = scratch_path(spark, "files")
    files.write_files(table(spark, d, "files").select("file_id", "name", "content"), folder)
    return spark.read.parquet(folder).select("file_id", "name", F.md5("content").alias("md5"))


def q_loose_files(spark, d):
    """Texts written as loose files and read back through the data source."""
    folder = scratch_path(spark, "texts")
    loose.write_loose(table(spark, d, "files"), folder, "path")
    return loose.read_loose(spark, folder, "*.txt").select(F.regexp_extract("name", r"^([0-9]+)\.", 1).cast("long").alias("file_id"), "length", F.md5("content").alias("md5"))


def q_loose_fingerprints(spark, d):
    folder = scratch_path(spark, "texts")
    loose.write_loose(table(spark, d, "files"), folder, "path")
    return loose.read_loose(spark, folder, holds="fingerprint").select(F.regexp_extract("name", r"^([0-9]+)\.", 1).cast("long").alias("file_id"), "fingerprint")


def q_confirmed_duplicates(spark, d):
    return digest.confirmed_duplicates(table(spark, d, "files"), "file_id")


def q_confirmed_loose_duplicates(spark, d):
    folder = scratch_path(spark, "texts")
    loose.write_loose(table(spark, d, "files"), folder, "path")
    return digest.confirmed_loose_duplicates(spark, folder).select("sha256", "n", "wasted")


def q_restore_generic(spark, d):
    """Three to five frames without a marker: moving in mode web from two frames, in mode java from five."""
    n = pngs(spark, d).select(C("path").cast("long").alias("n"), "content")
    owner = n.select("content", F.floor(C("n") / 6).alias("g"), (C("n") % 6).alias("k"))
    frames = F.transform(F.array_sort(F.collect_list(F.when(C("k") > 0, F.struct("k", C("content").alias("png"), F.lit(40).alias("delay_ms"))))), lambda s: F.struct(s["png"].alias("png"), s["delay_ms"].alias("delay_ms")))
    whole = owner.groupBy("g").agg(F.max(F.when(C("k") == 0, C("content"))).alias("cover"), frames.alias("frames")).filter(F.size("frames") > 0)
    disguised = container.compose(whole.select(C("g").alias("path"), "cover", F.slice("frames", F.lit(1), (3 + C("g") % 3).cast("int")).alias("frames")), "ANIMATED")
    plain = metadata.strip_metadata(disguised)
    web, java = (container.restore(plain, m).withColumn("mode", F.lit(m)) for m in ("web", "java"))
    both = web.unionByName(java).withColumn("n", C("path").cast("long") * 6 + C("frame_no"))
    return both.join(n.withColumnRenamed("content", "was"), "n").select("path", "mode", "frame_no", "is_anim", "delay_ms", (C("png") == C("was")).alias("as_hidden"))


def gifs(spark, d) -> DataFrame:
    """Two images make a GIF: the first whole, a part of the second over it or in its stead (by the first's disposal)."""
    p = px(spark, d)
    grey = lambda rows: rows.groupBy("image_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.lpad(F.hex("r"), 2, "0").alias("v")))), lambda s: s["v"]), "")).alias("grey"))
    first = grey(p.filter("image_id % 2 = 0")).select(C("image_id").alias("path"), F.lit(1).alias("frame_no"), F.lit(0).alias("delay_ms"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"), (1 + C("image_id") % 4 / 2).cast("int").alias("disposal"), "grey")
    part = p.filter("image_id % 2 = 1 AND x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 7")
    second = grey(part).select((C("image_id") - 1).alias("path"), F.lit(2).alias("frame_no"), (C("image_id") % 9 * 10 + 20).cast("int").alias("delay_ms"), F.lit(2).alias("x"), F.lit(3).alias("y"), F.lit(4).alias("w"), F.lit(5).alias("h"), F.lit(1).alias("disposal"), "grey")
    return container.gif_of_frames(first.unionByName(second), F.when(C("path").cast("long") % 3 > 0, C("path").cast("long") % 5))


def q_gif_frames(spark, d):
    return container.gif_frames(gifs(spark, d)).select("path", "frame_no", "delay_ms", "x", "y", "w", "h", "screen_w", "screen_h", "loops", F.lower(F.hex("rgba")).alias("rgba"))


def jpegs(spark, d) -> DataFrame:
    """files(path, content): the start image and comment, scan and end marks of a JPEG around each vector's number."""
    v = table(spark, d, "embeddings").select(C("vec_id").cast("string").alias("path"))
    return v.select("path", F.concat(F.unhex(F.lit("FFD8FFFE")), F.unhex(F.lpad(F.hex(F.length("path") + 2), 4, "0")), F.encode("path", "UTF-8"), F.unhex(F.lit("FFDA0002")), F.encode(F.md5(F.encode("path", "UTF-8")), "UTF-8"), F.unhex(F.lit("FFD9"))).alias("content"))


def placed(spark, d) -> DataFrame:
    """fields: every image's own place and maker."""
    v = table(spark, d, "embeddings").select(C("vec_id").alias("n"))
    none, text = F.lit(None).cast("array<long>"), F.lit(None).cast("string")
    angle = lambda deg, k: F.array(deg, F.lit(1), C("n") * k % 60, F.lit(1), C("n") * k * 7 % 6000, F.lit(100)).cast("array<long>")
    field = lambda ifd, tag, kind, t, nums: F.struct(F.lit(ifd).alias("ifd"), F.lit(tag).alias("tag"), F.lit(kind).alias("type"), t.alias("text"), nums.alias("nums"))
    own = F.array(
        field("ifd0", 0x010F, 2, F.concat(F.lit("Maker "), C("n") % 11), none), field("exif", 0x829A, 5, text, F.array(F.lit(1), C("n") % 250 + 1).cast("array<long>")),
        field("gps", 1, 2, F.when(C("n") % 2 == 0, "N").otherwise("S"), none), field("gps", 2, 5, text, angle(C("n") % 90, 1)),
        field("gps", 3, 2, F.when(C("n") % 3 == 0, "E").otherwise("W"), none), field("gps", 4, 5, text, angle(C("n") % 179, 3)))
    return v.select(C("n").cast("string").alias("path"), F.explode(own).alias("f")).select("path", "f.*")


def with_places(spark, d) -> DataFrame:
    """Images as PNG, and JPEGs beside them, with their own fields."""
    own = placed(spark, d)
    png_side = metadata.write_exif_rows(pngs(spark, d), own).withColumn("kind", F.lit("PNG"))
    return png_side.unionByName(metadata.write_exif_rows(jpegs(spark, d), own).withColumn("kind", F.lit("JPEG")))


def q_exif_places(spark, d):
    both = with_places(spark, d).withColumn("path", F.concat_ws("/", catalog.sniff_type(C("content")), "path"))
    return metadata.gps_decimal(metadata.exif_tags(both))


def q_exif_values(spark, d):
    both = with_places(spark, d).withColumn("path", F.concat_ws("/", "kind", "path"))
    return metadata.exif_tags(both).filter("ifd <> 'gps'").select("path", "name", "value", F.round(F.get("nums", F.lit(0)), 9).alias("first"))


def q_jpeg_strip(spark, d):
    marked = metadata.write_exif_rows(jpegs(spark, d), placed(spark, d))
    plain = metadata.strip_metadata(marked)
    return plain.select("path", F.md5("content").alias("md5"), F.length("content").alias("length"))


def q_jpeg_segments(spark, d):
    marked = metadata.write_exif_rows(jpegs(spark, d), placed(spark, d))
    return metadata.jpeg_segments(marked).select("path", "segment_no", "marker", F.substring("payload", 1, 4).cast("string").alias("head"))


def in_sql(spark, d, files: DataFrame, name: str, columns: str) -> DataFrame:
    """A parser called by LATERAL on files(path, content)."""
    table_functions.register_table_functions(spark, "parse_")
    return spark.sql(f"SELECT f.path, {columns} FROM {{files}} f, LATERAL parse_{name}(f.content) r", files=files)


def q_lateral_png_chunks(spark, d):
    rows = in_sql(spark, d, pngs(spark, d), "png_chunks", "r.chunk_no, r.type, r.length, r.payload, r.crc")
    return rows.select(C("path").cast("long").alias("path"), "chunk_no", "type", F.when(C("type") != "IDAT", C("length")).alias("length"), container.chunk_crc_ok(C("type"), C("payload"), C("crc")).alias("crc_ok"))


def q_lateral_jpeg_segments(spark, d):
    marked = metadata.write_exif_rows(jpegs(spark, d), placed(spark, d))
    return in_sql(spark, d, marked, "jpeg_segments", "r.segment_no, r.marker, CAST(substring(r.payload, 1, 4) AS STRING) AS head")


def q_lateral_exif_tags(spark, d):
    both = with_places(spark, d).withColumn("path", F.concat_ws("/", "kind", "path"))
    return in_sql(spark, d, both, "exif_tags", "r.name, r.value, round(get(r.nums, 0), 9) AS first, r.ifd").filter("ifd <> 'gps'").drop("ifd")


def q_lateral_gif_frames(spark, d):
    return in_sql(spark, d, gifs(spark, d), "gif_frames", "r.frame_no, r.delay_ms, r.x, r.y, r.w, r.h, r.screen_w, r.screen_h, r.loops, lower(hex(r.rgba)) AS rgba")


def q_jpeg_metadata(spark, d):
    found = metadata.metadata_chunks(metadata.write_exif_rows(jpegs(spark, d), placed(spark, d)))
    return found.select("path", "type", F.substring("payload", 1, 2).cast("string").alias("order"))


QUERIES = {k[2:]: job(v) for k, v in list(globals().items()) if k.startswith("q_")}

_INSPECT = """SELECT path, CASE WHEN m IS NULL THEN 1 ELSE m.v END::INT AS version, CASE WHEN m IS NULL THEN 'GENERIC' ELSE m.k END AS kind, CASE WHEN m IS NULL THEN n ELSE m.c END::BIGINT AS count FROM (
    SELECT path, bool_or(type = 'acTL') AS animated, count_if(type = 'fcTL') AS n,
      arg_min(CASE WHEN type = 'tEXt' AND keyword = 'disguise' AND len(string_split(value, ';')) = 3 THEN {{'v': try_cast(regexp_extract(split_part(value, ';', 1), '^\\s*([+-]?[0-9]+)', 1) AS INT), 'k': split_part(value, ';', 2), 'c': try_cast(regexp_extract(split_part(value, ';', 3), '^\\s*([+-]?[0-9]+)', 1) AS INT)}} END, chunk_no) FILTER (type = 'tEXt' AND len(string_split(value, ';')) = 3) AS m
    FROM {marked_chunks} GROUP BY path) WHERE animated AND n > 0""".replace("{{", "struct_pack(").replace("}}", ")").replace("'v': ", "v := ").replace("'k': ", "k := ").replace("'c': ", "c := ")
_FRAMES = "SELECT (vec_id - vec_id % 3)::VARCHAR AS path, (vec_id % 3)::INT AS frame_no, (vec_id - vec_id % 3) % 2 = 1 AS moving FROM embeddings WHERE vec_id % 3 > 0 AND (vec_id % 3 = 1 OR (vec_id - vec_id % 3) % 2 = 1)"
_HIDDEN = "SELECT path, count_if(NOT (w = 1 AND h = 1))::BIGINT AS hidden FROM {frames} GROUP BY path"
_HEX = "string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x)"
_OVER = "(SELECT p.image_id, p.x, p.y, q.r AS over, p.r FROM {pixels} p LEFT JOIN {pixels} q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y AND q.x BETWEEN 2 AND 5 AND q.y BETWEEN 3 AND 7 WHERE p.image_id % 2 = 0)"
#: What is left of a JPEG when EXIF and comments are gone.
_JPEG = "unhex('FFD8FFDA0002') || encode(md5(p)) || unhex('FFD9')"
_ANGLE = "({d} + vec_id * {k} % 60 / 60 + vec_id * {k} * 7 % 6000 / 100.0::DOUBLE / 3600)"
_MS = "floor(CASE WHEN delay_num = 0 THEN 10 ELSE delay_num END * 1000 / CASE WHEN delay_den = 0 THEN 100 ELSE delay_den END + 0.5)"

ORACLE_SQL = {k: duck(v) for k, v in {
    "inspect_disguise": _INSPECT,
    "frame_pieces": """SELECT path, frame_no, count(held) AS pieces, coalesce(sum(held), 0)::BIGINT AS bytes FROM (SELECT path, frame_no, CASE WHEN type = 'IDAT' THEN length WHEN type = 'fdAT' AND length >= 4 THEN length - 4 END AS held FROM (
        SELECT *, sum((type = 'fcTL')::INT) OVER (PARTITION BY path ORDER BY chunk_no)::INT AS frame_no FROM {chunks}) WHERE type <> 'acTL' AND frame_no > 0) GROUP BY 1, 2""",
    "count_hidden_frames": _HIDDEN,
    "restore_plan": f"SELECT path, kind, hidden, kind = 'ANIMATED' OR hidden >= 2 AS is_anim, CASE WHEN kind = 'GENERIC' THEN 'generic' WHEN kind = 'ANIMATED' OR hidden >= 2 THEN 'animated' ELSE 'static' END AS label, CASE WHEN kind = 'ANIMATED' OR hidden >= 2 THEN 'gif' ELSE 'png' END AS ext FROM ({_INSPECT}) JOIN ({_HIDDEN}) USING (path) WHERE hidden > 0",
    "frame_delay_ms": f"SELECT path, frame_no, CASE WHEN NOT has_ctl THEN 100 WHEN {_MS} < 10 THEN 20 ELSE {_MS} END::INT AS web, CASE WHEN NOT has_ctl THEN 100 WHEN {_MS} <= 10 THEN 100 ELSE {_MS} END::INT AS java FROM {{frames}}",
    "number_frames": "SELECT path, chunk_no, sum((type = 'fcTL')::INT) OVER (PARTITION BY path ORDER BY chunk_no)::INT AS frame_no FROM {chunks}",
    "png_chunks": "SELECT vec_id AS path, n AS chunk_no, type, length::BIGINT AS length, true AS crc_ok FROM embeddings, (VALUES (0, 'IHDR', 13), (1, 'IDAT', NULL), (2, 'IEND', 0)) t(n, type, length)",
    "frame_control": f"SELECT path, frame_no::BIGINT AS frame_no, 1 AS pieces, CASE WHEN moving THEN frame_no * 2 - 2 ELSE 0 END::BIGINT AS seq, 8::BIGINT AS w, 8::BIGINT AS h, CASE WHEN moving THEN frame_no * 4 ELSE 10 END::BIGINT AS delay_num, 100::BIGINT AS delay_den, 0::BIGINT AS dispose, 0::BIGINT AS blend FROM ({_FRAMES})",
    "restore": f"SELECT path, frame_no, moving AS is_anim, CASE WHEN moving THEN frame_no * 40 ELSE 100 END AS delay_ms, true AS as_hidden FROM ({_FRAMES})",
    "extract_cover": f"SELECT DISTINCT path, true AS as_before FROM ({_FRAMES})",
    "metadata_chunks": "SELECT vec_id::VARCHAR AS path, type FROM embeddings, (VALUES ('eXIf'), ('tEXt')) t(type)",
    "image_header": "SELECT vec_id::VARCHAR AS path, 8::BIGINT AS width, 8::BIGINT AS height FROM embeddings",
    "trailing_bytes": "SELECT vec_id::VARCHAR AS path, (vec_id % 5)::BIGINT AS tail, true AS same_payload FROM embeddings",
    "strip_metadata": "SELECT vec_id::VARCHAR AS path, true AS as_before FROM embeddings",
    "gps_decimal": """SELECT path, lat, lon FROM (SELECT path, round(max(CASE WHEN name = 'GPSLatitude' THEN (nums[1] + nums[2] / 60 + nums[3] / 3600) * CASE WHEN value = 'S' THEN -1 ELSE 1 END END), 6) AS lat, round(max(CASE WHEN name = 'GPSLongitude' THEN (nums[1] + nums[2] / 60 + nums[3] / 3600) * CASE WHEN value = 'W' THEN -1 ELSE 1 END END), 6) AS lon FROM {tags} GROUP BY path) WHERE abs(lat) <= 90 AND abs(lon) <= 180""",
    "sensitive_tags": "SELECT name, count(*) AS n, max(path) AS last FROM {tags} WHERE name IN ('GPSLatitude', 'GPSLongitude', 'OwnerName', 'GPSTimeStamp') GROUP BY 1",
    "has_hidden_info": "SELECT DISTINCT o_custkey AS path, (o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) OR o_custkey IN (SELECT path FROM {frames}) AS has_info FROM orders",
    "is_generation_params": "SELECT path, chunk_no, regexp_matches(lower(concat(coalesce(keyword, ''), chr(10), left(coalesce(value, ''), 400))), '" + "|".join(metadata.HINTS) + "') OR length(coalesce(value, '')) > 300 AS is_important FROM {text_chunks}",
    "text_export": "SELECT path, chunk_no, concat(CASE WHEN k = '' THEN 'text' ELSE k END, '.txt') AS file_name, chars FROM (SELECT path, chunk_no, regexp_replace(coalesce(keyword, ''), '[^A-Za-z0-9_.-]', '', 'g') AS k, length(value)::INT AS chars FROM {text_chunks})",
    "text_chunks": "SELECT conv_id::VARCHAR AS path, keyword, md5(value) AS value_md5, regexp_matches(lower(concat(keyword, chr(10), left(value, 400))), '" + "|".join(metadata.HINTS) + "') OR length(value) > 300 AS is_important FROM (SELECT conv_id % (SELECT count(*) FROM embeddings) AS conv_id, CASE WHEN conv_id % 5 = 0 THEN concat(role, ' prompt!') ELSE role END AS keyword, text AS value FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)",
    "write_exif": "SELECT vec_id AS path, ifd, name, value, f AS first FROM embeddings, (VALUES ('ifd0', 'Make', 'Maker', -1.0::DOUBLE), ('ifd0', 'DateTime', '2024:05:06 07:08:09', -1.0::DOUBLE), ('exif', 'ExposureTime', NULL, 1 / 125.0::DOUBLE), ('gps', 'GPSLatitudeRef', 'S', -1.0::DOUBLE), ('gps', 'GPSLatitude', NULL, 33.0::DOUBLE), ('gps', 'GPSLongitudeRef', 'W', -1.0::DOUBLE), ('gps', 'GPSLongitude', NULL, 70.0::DOUBLE)) t(ifd, name, value, f)",
    "gps_of_files": "SELECT vec_id::VARCHAR AS path, round(-(33 + 51 / 60 + 30.5::DOUBLE / 3600), 6) AS lat, round(-(70 + 40 / 60 + 12.25::DOUBLE / 3600), 6) AS lon FROM embeddings",
    "read_files": "SELECT vec_id AS image_id, 'PNG' AS kind, true AS whole, 8::BIGINT AS width, 8::BIGINT AS height FROM embeddings",
    "read_pixels": f"SELECT image_id, 8 AS w, 8 AS h, {_HEX} AS rgba FROM {{pixels}} GROUP BY image_id",
    "write_files": "SELECT file_id, name, md5(text) AS md5 FROM {files}",
    "restore_generic": """SELECT g::VARCHAR AS path, mode, k AS frame_no, n >= CASE mode WHEN 'web' THEN 2 ELSE 5 END AS is_anim, 40 AS delay_ms, true AS as_hidden
        FROM (SELECT vec_id // 6 AS g, least(3 + vec_id // 6 % 3, count(*) - 1) AS n FROM embeddings GROUP BY vec_id // 6), (VALUES ('web'), ('java')) m(mode), (VALUES (1), (2), (3), (4), (5)) f(k) WHERE k <= n AND (k = 1 OR n >= CASE mode WHEN 'web' THEN 2 ELSE 5 END)""",
    "gif_frames": f"""SELECT *, 8 AS screen_w, 8 AS screen_h, CASE WHEN path::BIGINT % 3 > 0 THEN path::BIGINT % 5 ELSE 0 END::INT AS loops FROM (SELECT image_id::VARCHAR AS path, 1 AS frame_no, 100 AS delay_ms, 0 AS x, 0 AS y, 8 AS w, 8 AS h, string_agg(printf('%02x%02x%02xff', r, r, r), '' ORDER BY y, x) AS rgba FROM {_OVER} GROUP BY image_id
        UNION ALL SELECT image_id::VARCHAR, 2, ((image_id + 1) % 9 * 10 + 20)::INT, 2, 3, 4, 5, string_agg(CASE WHEN over IS NOT NULL THEN printf('%02x%02x%02xff', over, over, over) WHEN image_id % 4 = 2 THEN '00000000' ELSE printf('%02x%02x%02xff', r, r, r) END, '' ORDER BY y, x) FROM {_OVER} WHERE image_id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY image_id)""",
    "exif_places": f"SELECT concat(kind, '/', vec_id) AS path, round(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END * {_ANGLE.format(d='vec_id % 90', k=1)}, 6) AS lat, round(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE -1 END * {_ANGLE.format(d='vec_id % 179', k=3)}, 6) AS lon FROM embeddings, (VALUES ('PNG'), ('JPEG')) t(kind)".replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}"),
    "exif_values": "SELECT concat(kind, '/', vec_id) AS path, name, CASE WHEN name = 'Make' THEN concat('Maker ', vec_id % 11) END AS value, CASE WHEN name <> 'Make' THEN round(1 / (vec_id % 250 + 1)::DOUBLE, 9) END AS first FROM embeddings, (VALUES ('PNG'), ('JPEG')) t(kind), (VALUES ('Make'), ('ExposureTime')) n(name)",
    "jpeg_strip": f"SELECT p AS path, md5({_JPEG}) AS md5, octet_length({_JPEG})::INT AS length FROM (SELECT vec_id::VARCHAR AS p FROM embeddings)",
    "jpeg_segments": "SELECT vec_id::VARCHAR AS path, n AS segment_no, marker, coalesce(head, left(vec_id::VARCHAR, 4)) AS head FROM embeddings, (VALUES (0, 225, 'Exif'), (1, 254, NULL)) t(n, marker, head)",
    "jpeg_metadata": "SELECT vec_id::VARCHAR AS path, 'eXIf' AS type, 'II' AS \"order\" FROM embeddings",
    "exif_fields": """SELECT id, floor(-log2(t) * 1000 + 0.5) / 1000 AS shutter, floor(2 * log2(f) * 100 + 0.5) / 100 AS aperture, CASE WHEN t < 1 THEN 1 ELSE floor(t * 1000 + 0.5) END::BIGINT AS exposure_num, CASE WHEN t < 1 THEN floor(1 / t + 0.5) ELSE 1000 END::BIGINT AS exposure_den, floor(focal * 1000 + 0.5)::BIGINT AS focal_milli,
        CASE WHEN focal = 6.06::DOUBLE THEN 23 WHEN focal = 2.3::DOUBLE THEN 15 ELSE floor(focal * 3.8::DOUBLE + 0.5) END::BIGINT AS focal_35mm FROM {exposures} WHERE t > 0""",
    "decimal_to_dms": "SELECT id, d::BIGINT AS d, m::BIGINT AS m, floor(((a - d) * 60 - m) * 6000 + 0.5)::BIGINT AS s100, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS ref FROM (SELECT *, floor((a - d) * 60) AS m FROM (SELECT *, abs(lat) AS a, floor(abs(lat)) AS d FROM {exposures}))",
    "parse_exposure": r"""SELECT id, CASE WHEN v > 0 AND NOT isinf(v) THEN v END AS seconds FROM (SELECT id, lat, lon, CASE WHEN regexp_matches(raw, '^[0-9.]+/[0-9.]+$') THEN CASE WHEN try_cast(split_part(raw, '/', 2) AS DOUBLE) <> 0 THEN try_cast(split_part(raw, '/', 1) AS DOUBLE) / try_cast(split_part(raw, '/', 2) AS DOUBLE) END ELSE try_cast(raw AS DOUBLE) END AS v FROM {exposures}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""",
    "decode_preset": """SELECT id, CASE WHEN ok THEN back END AS reversed, CASE WHEN ok THEN CASE WHEN back THEN 255 - tone ELSE 0 END END::INT AS low, CASE WHEN ok THEN CASE WHEN back THEN 255 ELSE tone END END::INT AS high, CASE WHEN ok AND c <= 100 THEN CASE WHEN floor((100 - c) * 255 / 50 - 255 + 0.5) = 0 THEN 0 ELSE 100 - c END END::INT AS contrast
        FROM (SELECT id, str, regexp_matches(str, '^.[0-9a-fA-F]{2}') AS ok, left(str, 1) = '1' AS back, try_cast('0x' || substr(str, 2, 2) AS INT) AS tone, CASE WHEN regexp_matches(str, '^.{3}[0-9a-fA-F]{2}') THEN try_cast('0x' || substr(str, 4, 2) AS INT) END AS c FROM {presets})""",
}.items()}
ORACLE_SQL |= {f"lateral_{k}": ORACLE_SQL[v] for k, v in (("png_chunks", "png_chunks"), ("jpeg_segments", "jpeg_segments"), ("exif_tags", "exif_values"), ("gif_frames", "gif_frames"))}
ORACLE_SQL |= {
    "restore_chunks": ORACLE_SQL["restore"],
    "loose_files": duck("SELECT file_id, length::BIGINT AS length, md5(text) AS md5 FROM {files}"),
    "loose_fingerprints": catalog_queries.ORACLE_SQL["sampled_fingerprint"],
    "confirmed_duplicates": catalog_queries.ORACLE_SQL["duplicate_groups"],
    "confirmed_loose_duplicates": f"SELECT sha256, n, wasted FROM ({catalog_queries.ORACLE_SQL['duplicate_groups']})",
}
