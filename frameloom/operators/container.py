"""Container tables: chunks of PNG and APNG files, hidden frames, covers, and their rebuilding.

The relational forms serve audits over chunk tables; `restore` does a whole file in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import gif, png

C = F.col
#: Columns of a chunk, and of a GIF's frame, behind the path.
CHUNK = "chunk_no int, type string, length long, end long, payload binary, crc long"
GIF_FRAME = "frame_no int, delay_ms int, x int, y int, w int, h int, disposal int, interlace boolean, trans_index int, screen_w int, screen_h int, loops int, rgba binary"
#: Arrow rows of files at a time: contents are large. Spark itself bounds what it sends to a worker at once by bytes
#: (spark.sql.execution.arrow.maxBytesPerBatch).
FILES_AT_ONCE = 32


def _per_file(files: DataFrame, make, schema: str, content: str = "content", path: str = "path") -> DataFrame:
    """make(path, content) yields the rows of each file."""
    types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(start, FILES_AT_ONCE)
                rows = [r for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in make(p, c)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    shape = _parse_datatype_string(schema)
    names, types = shape.names, [to_arrow_type(f.dataType) for f in shape.fields]
    return files.select(C(path).cast("string"), content).mapInArrow(run, shape)


def chunk_rows(content: bytes | None, only: tuple[str, ...] = (), strict: bool = False) -> Iterator[tuple]:
    """CHUNK of one file."""
    for n, kind, end, payload, crc in png.chunks(content, strict):
        yield n, kind, len(payload), end, payload if not only or kind in only else None, crc


def png_chunks(files: DataFrame, only: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """chunks(path, chunk_no, type, length, end, payload, crc); `only` drops the payloads of other types at once."""
    return _per_file(files, lambda path, content: ((path, *r) for r in chunk_rows(content, only, strict)), "path string, " + CHUNK)


def chunk_crc_ok(kind: Column, payload: Column, crc: Column) -> Column:
    return F.crc32(F.concat(F.encode(kind, "ISO-8859-1"), payload)) == crc


def trailing_bytes(files: DataFrame) -> DataFrame:
    """(path, tail, payload_md5): bytes behind IEND, and a digest without them, so that copies still group."""
    def make(path, content):
        last = list(png.chunks(content))[-1:]
        end = last[0][2] if last and last[0][1] == "IEND" else len(content or b"")
        yield path, len(content or b"") - end, (content or b"")[:end]

    return _per_file(files, make, "path string, tail long, kept binary").select("path", "tail", F.upper(F.md5("kept")).alias("payload_md5"))


def uint(payload: Column | str, at: int, n: int) -> Column:
    """A big-endian number of n bytes at an offset."""
    return F.conv(F.hex(F.substring(payload, at + 1, n)), 16, 10).cast("long")


def image_header(chunks: DataFrame) -> DataFrame:
    """(path, width, height) of the first IHDR."""
    first = chunks.filter("type = 'IHDR'").groupBy("path").agg(F.min_by("payload", "chunk_no").alias("p"))
    return first.select("path", uint("p", 0, 4).alias("width"), uint("p", 4, 4).alias("height"))


def marker_text(payload: Column) -> tuple[Column, Column]:
    """Keyword and value of a tEXt payload."""
    s = F.decode(payload, "ISO-8859-1")
    cut = F.instr(s, "\0")
    return F.when(cut > 0, F.substring(s, F.lit(1), cut - 1)), F.when(cut > 0, F.substring(s, cut + 1, F.length(s)))


def inspect_disguise(chunks: DataFrame, marker: str = png.MARKER, mode: str = "web") -> DataFrame:
    """(path, version, kind, count) of files with acTL and a frame; chunks need type, chunk_no, keyword, value.

    The first marker with three parts names version, kind and count (numbers as far as their leading digits go,
    null without any); mode java also asks for digits alone as the version. Without a marker the file is GENERIC.
    One conditional aggregation by path.
    """
    parts = F.split("value", ";")
    number = lambda k: F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    version, count = number(0), number(2)
    valid = (C("type") == "tEXt") & (C("keyword") == marker) & (F.size(parts) == 3)
    if mode == "java":
        valid &= F.get(parts, F.lit(0)).rlike("^[0-9]+$")
    seen = chunks.groupBy("path").agg(
        F.bool_or(C("type") == "acTL").alias("animated"), F.count_if(C("type") == "fcTL").alias("n"),
        F.min(F.when(valid, F.struct("chunk_no", version.alias("v"), F.get(parts, F.lit(1)).alias("k"), count.alias("c")))).alias("m"))
    return seen.filter(C("animated") & (C("n") > 0)).select(
        "path", *(F.when(C("m").isNull(), other).otherwise(C(f"m.{k}").cast(t)).alias(name) for name, k, other, t in (("version", "v", F.lit(1), "int"), ("kind", "k", F.lit("GENERIC"), "string"), ("count", "c", C("n"), "long"))))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with frame_no, the running count of fcTL in each file."""
    so_far = Window.partitionBy("path").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("frame_no", F.sum((C("type") == "fcTL").cast("int")).over(so_far))


def frame_pieces(chunks: DataFrame) -> DataFrame:
    """Per (path, frame_no): how many pieces, and their bytes; fdAT counts less its number, IDAT only behind the first fcTL."""
    data = numbered(chunks.filter(C("type").isin("fcTL", "fdAT", "IDAT"))).filter("frame_no > 0")
    held = F.when(C("type") == "IDAT", C("length")).when((C("type") == "fdAT") & (C("length") >= 4), C("length") - 4)
    return data.groupBy("path", "frame_no").agg(F.count(held).alias("pieces"), F.coalesce(F.sum(held), F.lit(0)).cast("long").alias("bytes"))


def frame_groups(chunks: DataFrame) -> DataFrame:
    """frames(path, frame_no, control, pieces) with payloads; a last frame of 1x1 is the heartbeat and goes."""
    data = numbered(chunks.filter(C("type").isin("fcTL", "fdAT", "IDAT"))).filter("frame_no > 0")
    piece = F.when(C("type") == "IDAT", C("payload")).when((C("type") == "fdAT") & (C("length") >= 4), F.substring("payload", F.lit(5), F.length("payload")))
    got = data.groupBy("path", "frame_no").agg(
        F.max(F.when(C("type") == "fcTL", C("payload"))).alias("control"),
        F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("chunk_no", piece.alias("p"))))), lambda s: s["p"]).alias("pieces"))
    last = F.max("frame_no").over(Window.partitionBy("path"))
    beat = (C("frame_no") == last) & (uint("control", 4, 4) == 1) & (uint("control", 8, 4) == 1)
    return got.withColumn("beat", F.coalesce(beat, F.lit(False))).filter("NOT beat").drop("beat")


def frame_control(frames: DataFrame) -> DataFrame:
    """frames with the fields of their 26-byte control record."""
    fields = {"seq": (0, 4), "w": (4, 4), "h": (8, 4), "x": (12, 4), "y": (16, 4), "delay_num": (20, 2), "delay_den": (22, 2), "dispose": (24, 1), "blend": (25, 1)}
    return frames.withColumns({k: F.when(F.length("control") >= 26, uint("control", *v)) for k, v in fields.items()})


def count_hidden_frames(frames: DataFrame) -> DataFrame:
    return frames.groupBy("path").agg(F.count_if(~((C("w") == 1) & (C("h") == 1))).alias("hidden"))


def restore_plan(info: DataFrame, hidden: DataFrame) -> DataFrame:
    """What each file becomes: animated when it says so or hides two frames or more. Both sides come by path."""
    moving = (C("kind") == "ANIMATED") | (C("hidden") >= 2)
    label = F.when(C("kind") == "GENERIC", "generic").when(moving, "animated").otherwise("static")
    return info.join(hidden, "path").filter("hidden > 0").select("path", "kind", "hidden", moving.alias("is_anim"), label.alias("label"), F.when(moving, "gif").otherwise("png").alias("ext"))


def frame_delay_ms(num: Column, den: Column, has_ctl: Column, mode: str = "web") -> Column:
    d, n = F.when(den == 0, 100).otherwise(den), F.when(num == 0, 10).otherwise(num)
    ms = F.floor(n * 1000 / d + 0.5)
    quick = F.when(ms < 10, 20).otherwise(ms) if mode == "web" else F.when(ms <= 10, 100).otherwise(ms)
    return F.when(~has_ctl, 100).otherwise(quick).cast("int")


def extract_cover(files: DataFrame) -> DataFrame:
    """(path, cover): the picture before the first fcTL as a file of its own, null where there is none."""
    def make(path, content):
        ihdr, data, framed = None, [], False
        for _, kind, _, payload, _ in png.chunks(content):
            framed = framed or kind == "fcTL"
            ihdr = payload if kind == "IHDR" and ihdr is None else ihdr
            if kind == "IDAT" and not framed:
                data.append(payload)
        yield path, png.frame_to_png(ihdr, data) if framed and data and ihdr else None

    return _per_file(files, make, "path string, cover binary")


def _hidden(content: bytes, mode: str) -> tuple[bytes | None, list[tuple[bytes, list[bytes]]], int]:
    """The first IHDR, (control, pieces) of each hidden frame, and the frames with the heartbeat counted in."""
    ihdr, groups, animated = None, [], False
    for _, kind, _, payload, _ in png.chunks(content, strict=mode == "java"):
        if kind == "IHDR" and ihdr is None:
            ihdr = payload
        elif kind == "acTL":
            animated = True
        elif kind == "fcTL":
            groups.append((payload, []))
        elif kind == "fdAT" and groups and len(payload) >= 4:
            groups[-1][1].append(payload[4:])
        elif kind == "IDAT" and groups:
            groups[-1][1].append(payload)
    if not animated or ihdr is None:
        return None, [], 0
    whole, side = len(groups), 1 if mode == "web" else 2
    if groups and len(groups[-1][0]) >= 12 and max(int.from_bytes(groups[-1][0][4:8], "big"), int.from_bytes(groups[-1][0][8:12], "big")) <= side:
        groups.pop()
    return ihdr, groups, whole


def restore(files: DataFrame, mode: str = "web", marker: str = png.MARKER) -> DataFrame:
    """(path, frame_no, is_anim, delay_ms, png) of every hidden frame, file by file: no shuffle.

    A file is animated if its marker says so, or, in mode web, if it hides two frames, in mode java if it holds five
    with the heartbeat counted in.
    """
    def make(path, content):
        ihdr, groups, whole = _hidden(content or b"", mode)
        if not groups:
            return
        said = next((v for _, k, _, p, _ in png.chunks(content) if k == "tEXt" and p.startswith(marker.encode() + b"\0") and len(v := p.split(b"\0", 1)[1].split(b";")) == 3 and (mode == "web" or v[0].isdigit())), None)
        moving = (said and said[1] == b"ANIMATED") or (len(groups) >= 2 if mode == "web" else whole >= 5)
        for n, (control, pieces) in enumerate(groups if moving else groups[:1], 1):
            full = len(control) >= 26
            w, h = (int.from_bytes(control[a : a + 4], "big") for a in (4, 8)) if full else (0, 0)
            num, den = (int.from_bytes(control[a : a + 2], "big") for a in (20, 22)) if full else (0, 0)
            ms = int((num or 10) * 1000 / (den or 100) + 0.5) if full else 100
            ms = (20 if ms < 10 else ms) if mode == "web" else (100 if ms <= 10 else ms)
            yield path, n, bool(moving), ms, png.frame_to_png(ihdr, pieces, w, h)

    return _per_file(files, make, "path string, frame_no int, is_anim boolean, delay_ms int, png binary")


def _be(number: Column, n: int = 4) -> Column:
    """A whole number as n big-endian bytes."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 2 * n, "0"), F.lit(2 * n)))


def chunk_bytes(kind: str, payload: Column) -> Column:
    """A chunk as it stands in a file: length, type, payload, CRC."""
    named = F.concat(F.encode(F.lit(kind), "ISO-8859-1"), payload)
    return F.concat(_be(F.length(payload)), named, _be(F.crc32(named)))


def restore_chunks(chunks: DataFrame, mode: str = "web", marker: str = png.MARKER) -> DataFrame:
    """restore() over a chunk table (path, chunk_no, type, length, payload), by column expressions alone.

    The pieces of a frame become chunks row by row, and are laid end to end in order by an ordered aggregate, so a frame of
    many pieces is copied once and only its own bytes meet in a task. In mode java the table must come from a strict parse.
    """
    keyword, value = marker_text(C("payload"))
    parts = F.split(value, ";")
    says = (C("type") == "tEXt") & (keyword == marker) & (F.size(parts) == 3)
    if mode == "java":
        says &= F.get(parts, F.lit(0)).rlike("^[0-9]+$")
    info = chunks.filter(C("type").isin("IHDR", "acTL", "tEXt")).groupBy("path").agg(
        F.min_by(F.when(C("type") == "IHDR", C("payload")), F.when(C("type") == "IHDR", C("chunk_no"))).alias("ihdr"),
        F.bool_or(C("type") == "acTL").alias("animated"),
        F.min_by(F.when(says, F.get(parts, F.lit(1))), F.when(says, C("chunk_no"))).alias("said")).filter("animated AND ihdr IS NOT NULL")

    data = numbered(chunks.filter(C("type").isin("fcTL", "fdAT", "IDAT"))).filter("frame_no > 0")
    piece = F.when(C("type") == "IDAT", C("payload")).when((C("type") == "fdAT") & (F.length("payload") >= 4), F.substring("payload", F.lit(5), F.length("payload")))
    packed = data.select("path", "frame_no", "chunk_no", F.when(C("type") == "fcTL", C("payload")).alias("control"), piece.alias("piece")).withColumn("packed", chunk_bytes("IDAT", C("piece")))
    frames = packed.groupBy("path", "frame_no").agg(F.max("control").alias("control"), F.expr("listagg(packed) WITHIN GROUP (ORDER BY chunk_no)").alias("data"))
    frames = frames.withColumn("whole", F.max("frame_no").over(Window.partitionBy("path")))
    side = 1 if mode == "web" else 2
    beat = (C("frame_no") == C("whole")) & (F.length("control") >= 12) & (F.greatest(uint("control", 4, 4), uint("control", 8, 4)) <= side)
    hidden = frames.filter(~F.coalesce(beat, F.lit(False))).withColumn("hidden", F.max("frame_no").over(Window.partitionBy("path")))

    moving = F.coalesce(C("said") == "ANIMATED", F.lit(False)) | (C("hidden") >= 2 if mode == "web" else C("whole") >= 5)
    full = F.length("control") >= 26
    sized = full & (uint("control", 4, 4) > 0) & (uint("control", 8, 4) > 0)
    head = F.when(sized, F.concat(F.substring("control", 5, 8), F.substring("ihdr", 9, 5))).otherwise(C("ihdr"))
    ms = frame_delay_ms(uint("control", 20, 2), uint("control", 22, 2), full, mode)
    out = hidden.join(info, "path").withColumn("is_anim", moving).filter(C("is_anim") | (C("frame_no") == 1))
    whole = F.concat(F.lit(png.SIGNATURE), chunk_bytes("IHDR", head), F.coalesce("data", F.lit(b"")), chunk_bytes("IEND", F.lit(b"")))
    return out.select("path", C("frame_no").cast("int").alias("frame_no"), "is_anim", ms.alias("delay_ms"), whole.alias("png"))


def compose(pairs: DataFrame, kind: str, marker: str = png.MARKER) -> DataFrame:
    """(path, content) of pairs(path, cover, frames array<struct<png, delay_ms>>): STATIC or ANIMATED disguises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [png.compose(r["cover"], [(f["png"], f["delay_ms"]) for f in r["frames"]], kind, marker) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return pairs.select(C("path").cast("string").alias("path"), "cover", "frames").mapInArrow(run, "path string, content binary")


def png_of_images(images: DataFrame) -> DataFrame:
    """(path, content): image blocks as PNG files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [png.encode(np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([str(r["image_id"]) for r in rows], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return images.select("image_id", "w", "h", "rgba").mapInArrow(run, "path string, content binary")


def gif_of_frames(frames: DataFrame, loops: Column | None = None) -> DataFrame:
    """(path, content) of frames(path, frame_no, delay_ms, x, y, w, h, disposal, grey): animated GIFs of 256 greys.

    grey has a byte for each pixel of the frame's rectangle. A file's frames are gathered in order. `loops` (of the path,
    or null) is how often a file plays.
    """
    one = F.struct("frame_no", "delay_ms", "x", "y", "w", "h", "disposal", "grey")
    whole = frames.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gif.encode([(f["delay_ms"], f["x"], f["y"], f["w"], f["h"], f["disposal"], f["grey"]) for f in fs], n) for fs, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return whole.select(C("path").cast("string").alias("path"), "frames", (F.lit(None) if loops is None else loops).cast("int").alias("loops")).mapInArrow(run, "path string, content binary")


def gif_rows(content: bytes | None) -> Iterator[tuple]:
    """GIF_FRAME of one file."""
    loops = gif.loops(content)
    for n, f in enumerate(gif.frames(content), 1):
        yield n, f.delay_ms, f.x, f.y, f.w, f.h, f.disposal, f.interlace, f.transparent, f.rgba.shape[1], f.rgba.shape[0], loops, f.rgba.tobytes()


def gif_frames(files: DataFrame) -> DataFrame:
    """Every frame of each GIF as a full picture, with the screen's size and how often the file plays (0: for ever, or not said)."""
    return _per_file(files, lambda path, content: ((path, *r) for r in gif_rows(content)), "path string, " + GIF_FRAME)
