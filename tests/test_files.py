"""Byte fixtures: containers, metadata, GIF frames, fingerprints, curves."""

import struct
import zlib

import numpy as np
import pytest

from frameloom.functions import fnv, gif, png, tiff
from frameloom.functions.gilbert import gilbert_curve
from frameloom.operators import container, decode, metadata, permute, pixels
from frameloom.streaming.history import history_stream

SCHEMA = "path string, content binary"


def picture(w, h, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


PLAIN, SECOND, THIRD = (png.encode(picture(5, 4, k)) for k in range(3))
STATIC = png.compose(PLAIN, [(SECOND, 0)], "STATIC")
MOVING = png.compose(PLAIN, [(SECOND, 40), (THIRD, 250)], "ANIMATED")


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in contents.items()], SCHEMA)


def generic():
    parts = [(k, p) for _, k, _, p, _ in png.chunks(MOVING) if k != "tEXt"]
    return png.assemble(parts)


def idat_behind():
    parts = [(k, p) for _, k, _, p, _ in png.chunks(STATIC)]
    first = next(i for i, (k, _) in enumerate(parts) if k == "IDAT")
    control = next(p for k, p in parts if k == "fcTL")
    return png.assemble([*parts[:first], ("fcTL", control), *parts[first:]])


def test_chunks_and_crc(spark):
    rows = container.png_chunks(files(spark, a=PLAIN, b=b"no picture", c=b"", d=None, e=PLAIN[:-20]))
    got = rows.withColumn("ok", container.chunk_crc_ok(rows["type"], rows["payload"], rows["crc"])).collect()
    assert [r["type"] for r in got if r["path"] == "a"] == ["IHDR", "IDAT", "IEND"]
    assert all(r["ok"] for r in got if r["path"] == "a")
    assert next(r["crc"] for r in got if r["type"] == "IEND") == 0xAE426082
    assert {r["path"] for r in got} == {"a", "e"}
    assert not list(png.chunks(PLAIN[:-20], strict=True))


def test_inspect_and_restore(spark):
    f = files(spark, plain=PLAIN, static=STATIC, moving=MOVING, generic=generic(), behind=idat_behind(), bad=b"x", none=None)
    c = container.png_chunks(f)
    keyword, value = container.marker_text(c["payload"])
    info = {r["path"]: (r["kind"], r["count"]) for r in container.inspect_disguise(c.withColumns({"keyword": keyword, "value": value})).collect()}
    assert info == {"static": ("STATIC", 1), "moving": ("ANIMATED", 2), "generic": ("GENERIC", 2), "behind": ("STATIC", 1)}
    got = {(r["path"], r["frame_no"]): r for r in container.restore(f).collect()}
    assert got["static", 1]["png"] == SECOND and not got["static", 1]["is_anim"]
    assert [got["moving", n]["png"] for n in (1, 2)] == [SECOND, THIRD]
    assert [got["moving", n]["delay_ms"] for n in (1, 2)] == [40, 250]
    assert got["generic", 1]["is_anim"]
    covers = {r["path"]: r["cover"] for r in container.extract_cover(f).collect()}
    assert covers["static"] == PLAIN and covers["plain"] is None and covers["behind"] is None


def test_relational_frames_match_restore(spark):
    f = files(spark, static=STATIC, moving=MOVING)
    frames = container.frame_control(container.frame_groups(container.png_chunks(f))).collect()
    assert sorted((r["path"], r["w"], r["h"], r["delay_num"]) for r in frames) == [("moving", 5, 4, 4), ("moving", 5, 4, 25), ("static", 5, 4, 10)]


def test_tail(spark):
    got = {r["path"]: (r["tail"], r["payload_md5"]) for r in container.trailing_bytes(files(spark, a=PLAIN, b=PLAIN + b"tail!", c=b"text")).collect()}
    assert got["a"][0] == 0 and got["b"][0] == 5 and got["a"][1] == got["b"][1] and got["c"][0] == 0


def text_png():
    parts = [(k, p) for _, k, _, p, _ in png.chunks(PLAIN)]
    texts = [("tEXt", b"Title\0caf\xe9"), ("iTXt", b"Note\0\0\0\0\0" + "grün".encode()), ("iTXt", b"Long\0\x01\0\0\0" + zlib.compress(b"parameters")), ("zTXt", b"Zip\0\0" + zlib.compress(b"steps: 20")), ("zTXt", b"Bad\0\0nozip"), ("tEXt", b"nokey")]
    return png.assemble([*parts[:-1], *texts, parts[-1]])


def test_texts(spark):
    f = files(spark, a=text_png(), b=PLAIN)
    got = [(r["keyword"], r["value"], r["is_important"]) for r in metadata.text_chunks(f).orderBy("chunk_no").collect()]
    assert got == [("Title", "café", False), ("Note", "grün", False), ("Long", "parameters", True), ("Zip", "steps: 20", True), ("Bad", None, False)]
    assert {r["path"]: r["content"] for r in metadata.strip_metadata(f).collect()} == {"a": PLAIN, "b": PLAIN}


FIELDS = [("ifd0", 0x010F, 2, "Maker"), ("exif", 0x9204, 10, [(-1, 3)]), ("exif", 0xBEEF, 3, [7]), ("gps", 1, 2, "S"), ("gps", 2, 5, [(33, 1), (30, 1), (0, 1)]), ("gps", 3, 2, "W"), ("gps", 4, 5, [(70, 1), (15, 1), (0, 1)])]


def big_endian():
    """The same block by the other byte order: one entry."""
    return b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHI", 0x0112, 3, 1) + struct.pack(">HH", 6, 0) + b"\0\0\0\0"


def test_exif(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data"
    f = files(spark, p=PLAIN, j=jpeg, m=tiff.insert_jpeg(jpeg, big_endian()), n=b"", x=None)
    written = metadata.write_exif(f.filter("path IN ('p', 'j')"), FIELDS)
    tags = metadata.exif_tags(written.unionByName(f.filter("path NOT IN ('p', 'j')"))).collect()
    for path in "pj":
        by = {r["name"]: r for r in tags if r["path"] == path}
        assert by["Make"]["value"] == "Maker" and by["0xBEEF"]["nums"] == [7.0] and by["ExposureBiasValue"]["nums"] == pytest.approx([-1 / 3])
    assert [(r["name"], r["nums"]) for r in tags if r["path"] == "m"] == [("Orientation", [6.0])]
    gps = metadata.gps_decimal(metadata.exif_tags(written)).collect()
    assert {(r["lat"], r["lon"]) for r in gps} == {(-33.5, -70.25)}
    assert {r["path"]: r["content"] for r in metadata.strip_metadata(written).collect()} == {"p": PLAIN, "j": jpeg}


def lzw_pack(index):
    """Uncompressed LZW: a clear code before the table would grow past its width."""
    codes = []
    for i, v in enumerate(index):
        if i % 2 == 0:
            codes.append(4)
        codes.append(v)
    codes.append(5)
    bits = sum(c << (3 * i) for i, c in enumerate(codes))
    raw = bits.to_bytes((3 * len(codes) + 7) // 8, "little")
    return b"\x02" + bytes([len(raw)]) + raw + b"\0"


def animated_gif():
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for disposal, delay, clear, (x, y, w, h), index, interlace in ((1, 0, None, (0, 0, 2, 2), [1, 1, 2, 2], True), (2, 5, None, (0, 0, 1, 1), [3], False), (3, 7, 0, (1, 1, 1, 1), [0], False)):
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if interlace else 0) + lzw_pack(index)
    return out + b"\x3b"


def test_gif(spark):
    got = container.gif_frames(files(spark, g=animated_gif(), n=b"GIF89a", x=None)).orderBy("frame_no").collect()
    assert [(r["delay_ms"], r["disposal"]) for r in got] == [(100, 1), (50, 2), (70, 3)]
    red, green, blue, none = b"\xff\0\0\xff", b"\0\xff\0\xff", b"\0\0\xff\xff", b"\0\0\0\0"
    assert got[0]["rgba"] == red + red + green + green
    assert got[1]["rgba"] == blue + red + green + green
    assert got[2]["rgba"] == none + red + green + green


def test_fingerprint_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 5000, 20_000)]
    for raw, got in zip(rows, fnv.fold([fnv.sampled(r) for r in rows]).tolist(), strict=True):
        acc = 2166136261
        for b in raw[:: max(1, len(raw) // 4096)] + raw[max(0, len(raw) - 64) :]:
            acc = (acc ^ b) * 16777619 % 2**32
        assert got == acc


@pytest.mark.parametrize("w", [1, 2, 3, 7, 12])
@pytest.mark.parametrize("h", [1, 2, 5, 8, 13])
def test_curve_visits_every_cell(w, h):
    c = gilbert_curve(w, h)
    assert len({tuple(x) for x in c.tolist()}) == w * h
    assert len(c) < 2 or np.abs(np.diff(c, axis=0)).max() == 1


def test_scramble_forms_agree(spark):
    p = spark.range(0, 48).selectExpr("id % 2 AS image_id", "CAST(id div 2 % 6 AS INT) AS x", "CAST(id div 12 AS INT) AS y").selectExpr("*", "x * 7 AS r", "y * 9 AS g", "x + y AS b", "255 AS a")
    curve = permute.curves(spark.sql("SELECT 6 AS w, 4 AS h"))
    want = sorted(map(tuple, permute.scramble_pixels(p, curve, 6, 4).collect()))
    got = sorted(map(tuple, pixels.to_pixels(permute.scramble(pixels.to_images(p))).collect()))
    assert got == want


def test_drift_forms_agree(spark):
    p = spark.range(0, 200).selectExpr("id AS image_id", "0 AS x", "0 AS y", "CAST(id AS INT) AS r", "CAST(255 - id AS INT) AS g", "CAST(id * 7 % 256 AS INT) AS b", "255 AS a")
    three = pixels.yuv_drift(p, 3)
    four = sorted(map(tuple, pixels.yuv_drift(three, 1).collect()))
    assert sorted(map(tuple, pixels.yuv_drift(p, 4).collect())) == four


def test_diffusion_stops():
    rgba, known = np.zeros((3, 3, 4), np.uint8), np.zeros((3, 3), bool)
    assert not decode.diffuse_block(rgba, known, 5)[1].any()
    known[0, 0] = True
    rgba[0, 0] = 200
    out, full = decode.diffuse_block(rgba, known, 5)
    assert full.all() and (out == 200).all()


def brute_diffusion(rgba, known):
    """All synchronous rounds, pixel by pixel."""
    h, w = known.shape
    while True:
        was, there, changed = rgba.copy(), known.copy(), False
        for y, x in zip(*np.where(~there), strict=True):
            near = [(k, was[y + dy, x + dx].astype(float)) for dx, dy, k in decode.OFFSETS if 0 <= x + dx < w and 0 <= y + dy < h and there[y + dy, x + dx]]
            if near:
                rgba[y, x] = [round(round(float(sum(k * v[c] for k, v in near)) / sum(k for k, _ in near), 6)) for c in range(4)]
                known[y, x] = changed = True
        if not changed:
            return rgba, known


def test_diffusion_of_many_rounds(spark):
    h, w, rows = 9, 14, []
    for i in range(3):
        rng = np.random.default_rng(i)
        at = np.full((h, w), 250)
        # Image 0 has two known corners, image 1 one spot, image 2 nothing in its window.
        for y, x in [[(0, 0), (8, 13), (1, 0)], [(4, 2)], []][i]:
            at[y, x] = rng.integers(40, 90)
        rows += [(i, x, y, int(at[y, x]), int(at[y, x]), int(at[y, x]), 255) for y in range(h) for x in range(w)]
    p = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    presets = spark.createDataFrame([(i, 30, 100, 0) for i in range(3)], "image_id long, low int, high int, contrast int")
    decoded = decode.window_decode(p.join(presets, "image_id"))
    want = {}
    for i in range(3):
        rgba, known = np.zeros((h, w, 4), np.uint8), np.zeros((h, w), bool)
        for r in decoded.filter(f"image_id = {i}").collect():
            rgba[r["y"], r["x"]], known[r["y"], r["x"]] = [r[c] for c in "rgba"], not r["is_fill"]
        rgba, known = brute_diffusion(rgba, known)
        want |= {(i, x, y): (*map(int, rgba[y, x]), not known[y, x]) for y in range(h) for x in range(w)}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in decode.decode_pipeline(p, presets).collect()}
    assert got == want
    assert {i: sum(v[4] for k, v in got.items() if k[0] == i) for i in range(3)} == {0: 0, 1: 0, 2: h * w}


def test_partition_count_does_not_matter(spark):
    f = files(spark, **{f"f{i}": (STATIC, MOVING, PLAIN)[i % 3] for i in range(12)})
    one, many = (sorted(map(tuple, container.restore(f.repartition(n)).collect())) for n in (1, 8))
    assert one == many


def test_history_stream(spark, tmp_path):
    source, snapshot = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "a", "x", b"1"), (2, "a", "x", b"2"), (3, "b", None, b"3")]
    schema = "id long, type string, dedupe_key string, content binary"
    spark.createDataFrame(rows, schema).write.parquet(source + "/one")
    run = lambda: history_stream(spark, source + "/*", schema, snapshot, str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([(4, "a", "x", b"4"), (5, "b", None, b"5")], schema).write.parquet(source + "/two")
    run()
    from frameloom.streaming.history import current

    assert sorted(r["id"] for r in current(spark, snapshot).collect()) == [3, 4, 5]


