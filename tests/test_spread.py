"""Forms that hold no image in one task, and byte building in the JVM, against the block forms."""

import numpy as np
import pytest

from frameloom.jobs import pixel_queries
from frameloom.operators import blend, container, decode, pixels
from frameloom.functions import png
from oracle import SF, connection, rows_of
from test_files import MOVING, PLAIN, SECOND, STATIC, THIRD, files, generic, idat_behind, picture


def image_rows(spark, sizes, seed=0):
    rnd = np.random.default_rng(seed)
    rows = [(i, w, h, bytearray(rnd.integers(0, 256, (h, w, 4)).astype(np.uint8).tobytes())) for i, (w, h) in enumerate(sizes)]
    return spark.createDataFrame(rows, "image_id long, w int, h int, rgba binary")


@pytest.mark.parametrize("ratio", [0.5, 0.75, 0.3, 1.0, 1.5, 2.4])
def test_resize_forms_agree(spark, ratio):
    for w, h in ((8, 8), (13, 7), (1, 5)):
        images = image_rows(spark, [(w, h)] * 3, w)
        want = sorted(map(tuple, pixels.resize(pixels.to_pixels(images), w, h, ratio).collect()))
        assert sorted(map(tuple, pixels.to_pixels(pixels.resize_images(images, ratio)).collect())) == want


def test_noise_forms_agree(spark):
    images = image_rows(spark, [(20, 30), (3, 2), (1, 1)])
    want = sorted(map(tuple, pixels.gaussian_noise(pixels.to_pixels(images), 0.2, 9).collect()))
    assert sorted(map(tuple, pixels.to_pixels(pixels.gaussian_noise_images(images, 0.2, 9)).collect())) == want
    odd = spark.createDataFrame([(1, 0, 0, None)], images.schema)
    assert pixels.resize_images(odd, 2.0).count() == 0 == pixels.resize_images(images.limit(0), 2.0).count()


@pytest.mark.parametrize("rounds", [None, 0, 1, 3])
def test_diffusion_forms_agree(spark, rounds):
    rnd = np.random.default_rng(4)
    rows = []
    for i, share in enumerate((0.01, 0.3, 0.9, 0.0, 1.0)):
        for y in range(17):
            for x in range(23):
                rows.append((i, x, y, *map(int, rnd.integers(0, 256, 4)), not (rnd.random() < share)))
    decoded = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int, is_fill boolean")
    want = sorted(map(tuple, decode._filled_pixels(decode.diffuse_fill(pixels.to_known_images(decoded), rounds)).collect()))
    assert sorted(map(tuple, decode.diffuse_pixels(decoded, rounds).collect())) == want


def test_a_round_broadcasts_no_pixels(spark):
    got = pixel_queries.QUERIES["diffuse_round"](spark, SF)
    assert got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_round_on_odd_pixels(spark):
    """Repeated pixels, known and unknown at one place, and pixels without an image, a colour or a flag, beside the SQL."""
    kind = "image_id long, x int, y int, r int, g int, b int, a int, is_fill boolean"
    rows = [(1, x, 0, 10 * x, 20, 30, 255, x % 3 > 0) for x in range(9)] + [(1, 3, 0, 90, 80, 70, 6, False), (1, 4, 0, 1, 2, 3, 4, True), (1, 4, 0, 1, 2, 3, 4, True), (1, 7, 0, 9, 9, 9, 9, False)]
    rows += [(None, 0, 0, 5, 5, 5, 5, False), (None, 1, 0, 6, 6, 6, 6, True), (1, 5, 0, 8, 8, 8, 8, None), (1, 9, 1, 8, 8, 8, 8, None), (2, 0, 0, 7, 7, 7, 7, True), (3, 0, 0, None, 1, 1, 1, False), (3, 0, 1, 2, 2, 2, 2, True), (3, 1, 1, 4, 4, 4, 4, False)]
    con = connection()
    con.execute(f"CREATE TABLE decoded ({kind.replace('long', 'bigint')})")
    con.executemany("INSERT INTO decoded VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    cur = con.execute(pixel_queries._diffused("(SELECT * FROM decoded)"))
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    df = decode.diffuse_round(spark.createDataFrame(rows, kind))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_no_join_by_image_alone(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dual_blend", "stripe_interleave", "weighted_interleave", "decode_pipeline", "decode_pipeline_rounds"):
            plan = pixel_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.split("\n") if "SortMergeJoin" in line or "HashJoin" in line]
            assert any("_line" in line for line in joins), name
            assert all("_line" in line or "x#" in line or "low#" not in line for line in joins), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_pairs_of_images(spark):
    p = pixels.to_pixels(image_rows(spark, [(3, 2), (3, 2), (2, 40)]))
    pairs = spark.createDataFrame([(7, 0, 1), (8, 1, 1), (9, 0, 5), (10, 0, 2), (11, None, 1)], "pair_id long, inner_id long, cover_id long")
    rows = {(r["image_id"], r["x"], r["y"]): tuple(r[c] for c in "rgba") for r in p.collect()}
    want = {(k, x, y, *v, *rows[c, x, y]) for k, i, c in ((7, 0, 1), (8, 1, 1), (10, 0, 2)) for (im, x, y), v in rows.items() if im == i and (c, x, y) in rows}
    got = [tuple(r[c] for c in ("pair_id", "x", "y", *"rgba", "cr", "cg", "cb", "ca")) for r in blend.paired(p, pairs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_pictures_are_built_without_python(spark, tmp_path):
    five = png.compose(PLAIN, [(png.encode(picture(3, 2, k)), 5 * k) for k in range(6)], "ANIMATED")
    many = png.assemble([("IHDR", png.header(4, 4)), ("acTL", bytes(8)), ("fcTL", png.frame_control(0, 4, 4, 1, 10)), *(("fdAT", bytes(4) + bytes([k % 256]) * (k % 7)) for k in range(300)), ("fdAT", b"abc"), ("IEND", b"")])
    short = png.assemble([("IHDR", png.header(4, 4)), ("acTL", bytes(8)), ("fcTL", b"short"), ("IDAT", b"x"), ("fcTL", png.frame_control(0, 0, 4, 0, 0)), ("IEND", b"")])
    bare = png.assemble([(k, p) for _, k, _, p, _ in png.chunks(MOVING) if k != "acTL"])
    odd = png.assemble([*((k, p) for _, k, _, p, _ in png.chunks(STATIC) if k != "tEXt"), ("tEXt", b"disguise\0v;ANIMATED;1")])
    f = files(spark, plain=PLAIN, static=STATIC, moving=MOVING, generic=generic(), behind=idat_behind(), five=five, many=many, short=short, bare=bare, odd=odd, none=None, cut=MOVING[:-60])
    for mode in ("web", "java"):
        container.png_chunks(f, strict=mode == "java").write.mode("overwrite").parquet(str(tmp_path / mode))
        built = container.restore_chunks(spark.read.parquet(str(tmp_path / mode)), mode)
        want = sorted(map(repr, container.restore(f, mode).collect()))
        assert sorted(map(repr, built.collect())) == want
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan
    assert {bytes(r["png"]) for r in container.restore_chunks(container.png_chunks(f.filter("path = 'moving'"))).collect()} == {SECOND, THIRD}
    assert container.restore_chunks(container.png_chunks(f.limit(0))).count() == 0
