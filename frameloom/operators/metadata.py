"""Metadata of picture files: extraction, flags, removal, writing, and the values derived from it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import png, tiff
from frameloom.operators.container import _per_file

C = F.col
META = ("tEXt", "iTXt", "zTXt", "eXIf")
#: Tags that tell where, when or whose (fixed list of this library).
SENSITIVE = ("GPSLatitude", "GPSLongitude", "GPSAltitude", "GPSTimeStamp", "GPSDateStamp", "DateTime", "DateTimeOriginal", "DateTimeDigitized", "Artist", "Copyright", "CameraOwnerName", "OwnerName", "BodySerialNumber", "LensSerialNumber", "UserComment")
#: What gives away text written by picture generators (fixed list).
HINTS = ("parameters", "prompt", "negative", "steps", "sampler", "seed", "novelai", "stable diffusion", "checkpoint", "lora", "cfg", "denois", "comment")
HEAD, LONG = 400, 300


#: Columns of a JPEG's segment, a tag and a text, behind the path.
SEGMENT = "segment_no int, marker int, offset long, length int, payload binary"
TAG = "ifd string, ord int, tag int, name string, type int, n int, value string, nums array<double>"
TEXT = "chunk_no int, type string, keyword string, value string"


def segment_rows(content: bytes | None) -> Iterator[tuple]:
    """SEGMENT of one file."""
    for n, marker, at, payload in tiff.jpeg_segments(content):
        yield n, marker, at, len(payload), payload


def tag_rows(content: bytes | None) -> Iterator[tuple]:
    """TAG of one file."""
    yield from tiff.tags(tiff.exif_block(content, [(k, p) for _, k, _, p, _ in png.chunks(content)]))


def text_rows(content: bytes | None) -> Iterator[tuple]:
    """TEXT of one file."""
    for n, kind, _, payload, _ in png.chunks(content):
        if kind in ("tEXt", "iTXt", "zTXt") and (got := text_of(kind, payload)):
            yield n, kind, *got


def jpeg_segments(files: DataFrame) -> DataFrame:
    """segments(path, segment_no, marker, offset, length, payload) of JPEG files, up to the picture data; a segment that
    runs past the file's end is cut there."""
    return _per_file(files, lambda path, content: ((path, *r) for r in segment_rows(content)), "path string, " + SEGMENT)


def metadata_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_no, type, payload): text and EXIF chunks of PNG, the EXIF block of JPEG as eXIf without its prefix."""
    def make(path, content):
        for n, kind, _, payload, _ in png.chunks(content):
            if kind in META:
                yield path, n, kind, payload
        block = tiff.exif_block(content)
        if block is not None:
            yield path, 0, "eXIf", block

    return _per_file(files, make, "path string, chunk_no int, type string, payload binary")


def exif_tags(files: DataFrame) -> DataFrame:
    """tags(path, ifd, ord, tag, name, type, n, value, nums) of PNG and JPEG files."""
    return _per_file(files, lambda path, content: ((path, *r) for r in tag_rows(content)), "path string, " + TAG)


def gps_decimal(tags: DataFrame) -> DataFrame:
    """(path, lat, lon) in degrees; null parts, sides beyond 90 or 180, give no row."""
    pick = lambda name, c: F.max(F.when(C("name") == name, C(c)))
    wide = tags.filter(C("name").isin("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")).groupBy("path").agg(
        *(pick(f"GPS{s}", "nums").alias(k) for s, k in (("Latitude", "a"), ("Longitude", "b"))), *(pick(f"GPS{s}Ref", "value").alias(k) for s, k in (("Latitude", "ar"), ("Longitude", "br"))))
    degrees = lambda v, ref, bad: F.when(F.size(v) == 3, F.round((F.get(v, F.lit(0)) + F.get(v, F.lit(1)) / 60 + F.get(v, F.lit(2)) / 3600) * F.when(C(ref) == bad, -1).otherwise(1), 6))
    return wide.select("path", degrees("a", "ar", "S").alias("lat"), degrees("b", "br", "W").alias("lon")).filter("abs(lat) <= 90 AND abs(lon) <= 180")


def sensitive_tags(tags: DataFrame) -> DataFrame:
    return tags.filter(C("name").isin(*SENSITIVE))


def has_hidden_info(files: DataFrame, *found: DataFrame) -> DataFrame:
    """files with a flag: whether any of the tables has a row for the path."""
    keys = found[0].select("path")
    for f in found[1:]:
        keys = keys.unionByName(f.select("path"))
    return files.join(keys.distinct().withColumn("_hit", F.lit(True)), "path", "left").withColumn("has_info", F.coalesce("_hit", F.lit(False))).drop("_hit")


def text_of(kind: str, payload: bytes) -> tuple[str, str | None] | None:
    """Keyword and value of a text chunk; the value is null where it can't be read."""
    if b"\0" not in payload:
        return None
    key, rest = payload.split(b"\0", 1)
    keyword = key.decode("latin-1")
    try:
        if kind == "tEXt":
            return keyword, rest.decode("latin-1")
        if kind == "zTXt":
            return keyword, zlib.decompress(rest[1:]).decode("latin-1")
        packed, value = rest[0], rest[2:].split(b"\0", 2)[2]
        return keyword, (zlib.decompress(value) if packed else value).decode("utf-8")
    except (zlib.error, ValueError, IndexError, TypeError, AttributeError):
        return keyword, None


def is_generation_params(keyword: Column, value: Column) -> Column:
    """Whether a text looks like a generator's settings: a hint near its start, or its mere length."""
    head = F.lower(F.concat(F.coalesce(keyword, F.lit("")), F.lit("\n"), F.left(F.coalesce(value, F.lit("")), F.lit(HEAD))))
    return head.rlike("|".join(h.replace(".", r"\.") for h in HINTS)) | (F.length(F.coalesce(value, F.lit(""))) > LONG)


def text_chunks(files: DataFrame) -> DataFrame:
    """text_chunks(path, chunk_no, type, keyword, value, is_important)."""
    rows = _per_file(files, lambda path, content: ((path, *r) for r in text_rows(content)), "path string, " + TEXT)
    return rows.withColumn("is_important", is_generation_params(C("keyword"), C("value")))


def text_export(texts: DataFrame) -> DataFrame:
    """(path, chunk_no, file_name, value): each text as a file named by its keyword."""
    safe = F.regexp_replace(F.coalesce("keyword", F.lit("")), r"[^A-Za-z0-9_.-]", "")
    return texts.select("path", "chunk_no", F.concat(F.when(safe == "", "text").otherwise(safe), F.lit(".txt")).alias("file_name"), "value")


def strip_metadata(files: DataFrame) -> DataFrame:
    """(path, content) without EXIF, GPS and texts: PNG rebuilt from its other chunks, JPEG without APP1 and comments."""
    def make(path, content):
        parts = [(k, p) for _, k, _, p, _ in png.chunks(content)]
        if parts:
            yield path, png.assemble(x for x in parts if x[0] not in META)
            return
        out, at = b"", 0
        for _, marker, start, payload in tiff.jpeg_segments(content):
            if marker in (0xE1, 0xFE):
                out, at = out + content[at:start], start + 4 + len(payload)
        yield path, out + (content or b"")[at:]

    return _per_file(files, make, "path string, content binary")


def append_metadata(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, content) with meta(path, chunk_no, type, payload) put in before IEND, in order. One join by path."""
    kept = meta.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "type", "payload"))).alias("meta"))
    both = files.select("path", "content").join(kept, "path", "left")

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                parts = [(k, p) for _, k, _, p, _ in png.chunks(row["content"])]
                extra = [(m["type"], m["payload"]) for m in row["meta"] or ()]
                made.append(png.assemble([*(x for x in parts if x[0] != "IEND"), *extra, ("IEND", b"")]) if parts else row["content"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return both.mapInArrow(run, "path string, content binary")


def _with_exif(content: bytes | None, block: bytes) -> bytes | None:
    """The file with a TIFF block: PNG gets an eXIf chunk and a hex profile text, JPEG an APP1 segment."""
    parts = [(k, p) for _, k, _, p, _ in png.chunks(content)]
    if parts:
        profile = b"Raw profile type exif\0\nexif\n" + f"{len(block) + 6:8d}\n".encode() + (b"Exif\0\0" + block).hex().encode() + b"\n"
        return png.assemble([*(x for x in parts if x[0] != "IEND"), ("eXIf", block), ("tEXt", profile), ("IEND", b"")])
    return tiff.insert_jpeg(content, block) if (content or b"")[:2] == b"\xff\xd8" else content


def write_exif(files: DataFrame, fields: list[tuple]) -> DataFrame:
    """(path, content) with the given TIFF fields, the same in all files."""
    block = tiff.pack(fields)

    def make(path, content):
        yield path, _with_exif(content, block)

    return _per_file(files, make, "path string, content binary")


def write_exif_rows(files: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, content) with each file's own fields(path, ifd, tag, type, text, nums): text for ASCII, whole numbers else, a pair for each rational.

    One join by path; a file has some tens of fields. Files without fields stay as they are.
    """
    kept = fields.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ifd", "tag", "type", "text", "nums"))).alias("fields"))
    both = files.select("path", "content").join(kept, "path", "left")

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own = [(f["ifd"], f["tag"], f["type"], f["text"] if f["type"] == 2 else list(zip(f["nums"][::2], f["nums"][1::2], strict=True)) if f["type"] in (5, 10) else f["nums"]) for f in row["fields"] or ()]
                made.append(_with_exif(row["content"], tiff.pack(own)) if own else row["content"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return both.mapInArrow(run, "path string, content binary")


def exif_fields(t: Column, f: Column, focal: Column) -> dict[str, Column]:
    """Shutter and aperture in APEX units, exposure, focal length in thousandths, and the 35 mm equivalent."""
    up = lambda c: F.floor(c + 0.5)
    return {
        "shutter": up(-F.log2(t) * 1000) / 1000, "aperture": up(2 * F.log2(f) * 100) / 100,
        "exposure_num": F.when(t < 1, F.lit(1).cast("long")).otherwise(up(t * 1000)), "exposure_den": F.when(t < 1, up(1 / t)).otherwise(F.lit(1000).cast("long")),
        "focal_milli": up(focal * 1000), "focal_35mm": F.when(focal == 6.06, F.lit(23).cast("long")).when(focal == 2.3, F.lit(15).cast("long")).otherwise(up(focal * 3.8)),
    }


def decimal_to_dms(v: Column, north: str, south: str) -> Column:
    """STRUCT(d, m, s100, ref): degrees, minutes, hundredths of seconds (6000 may occur and is kept)."""
    a = F.abs(v)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    return F.struct(d.alias("d"), m.alias("m"), F.floor(((a - d) * 60 - m) * 6000 + 0.5).alias("s100"), F.when(v < 0, south).otherwise(north).alias("ref"))


def parse_exposure(raw: Column) -> Column:
    """Seconds of `a/b` or a decimal; null for anything else or not above zero."""
    both = r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*$"
    a, b = (F.regexp_extract(raw, both, k).try_cast("double") for k in (1, 2))
    v = F.when(raw.rlike(both), F.try_divide(a, b)).otherwise(F.trim(raw).try_cast("double"))
    return F.when(v > 0, v)


def valid_place(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def decode_preset(s: Column) -> Column:
    """STRUCT(reversed, low, high, contrast) of a short code: a flag, two hex digits of a tone, two of the contrast.

    A first character other than 1 means not reversed. Null for codes under three characters and bad digits of
    the tone; the contrast is null (left alone) for codes under five, bad digits, or beyond 100.
    """
    tone = F.conv(F.substring(s, 2, 2), 16, 10).cast("int")
    c = F.when(s.rlike("^.{3}[0-9a-fA-F]{2}"), F.conv(F.substring(s, 4, 2), 16, 10).cast("int"))
    contrast = F.when(c <= 100, F.when(F.floor((100 - c) * 255 / 50.0 - 255 + 0.5) == 0, 0).otherwise(100 - c)).cast("int")
    back = F.substring(s, 1, 1) == "1"
    return F.when(s.rlike("^.[0-9a-fA-F]{2}"), F.struct(back.alias("reversed"), F.when(back, 255 - tone).otherwise(0).alias("low"), F.when(back, 255).otherwise(tone).alias("high"), contrast.alias("contrast")))
