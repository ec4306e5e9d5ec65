"""Perceptual hashes, the Hamming join and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.jobs import pixel_queries
from frameloom.operators import components, pixels, similar
from oracle import SF


def brute_components(edges):
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(100, i) for i in range(40)] + [(200, 300)],
    [(k * 7 % 50, k * 11 % 50) for k in range(30)] + [(5, 5)],
    [],
])
def test_components(spark, edges):
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == brute_components([e for e in edges if e[0] != e[1]])
    assert len(got) == len({r["node"] for r in got})


def noisy(bands, n, rnd):
    out = list(bands)
    for bit in rnd.choice(similar.BANDS * similar.BAND_BITS, n, replace=False):
        out[bit // 16] ^= 1 << int(bit % 16)
    return out


def test_hamming_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "SALT_ROWS", 10)  # so that keys are salted here
    rnd = np.random.default_rng(0)
    rows = []
    for k in range(25):
        base = rnd.integers(0, 1 << 16, similar.BANDS).tolist()
        rows += [base] + [noisy(base, int(n), rnd) for n in rnd.integers(1, 16, 7)]
    rows += [[0] * similar.BANDS] + [noisy([0] * similar.BANDS, 1, rnd) for _ in range(60)]
    rows = list(map(list, dict.fromkeys(map(tuple, rows))))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, bands array<int>")
    want = {(i, j, d) for i, p in enumerate(rows) for j in range(i + 1, len(rows)) if (d := sum((a ^ b).bit_count() for a, b in zip(p, rows[j], strict=True))) <= 10}
    got = [tuple(r) for r in similar.hamming_pairs(df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {d for _, _, d in want} >= set(range(1, 11))
    with pytest.raises(ValueError):
        similar.hamming_pairs(df, 11)


def test_no_join_broadcasts(spark, monkeypatch):
    """However small the tables are: as Parquet they are always taken for small."""
    written = []

    def spied(write):
        def run(df, name):
            written.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, name)
        return run

    for module in (similar, components):
        for name in ("materialize", "keep"):
            monkeypatch.setattr(module, name, spied(getattr(module, name)))
    hashes = spark.createDataFrame([(i, [i // 4 % 2, i % 4, *[7] * (similar.BANDS - 2)]) for i in range(40)], "image_id long, bands array<int>")
    assert similar.similar_pictures(hashes).count() == 40
    assert {"keys", "pairs", "edges", "large", "small", "components", "similar"} <= {name for name, _ in written}
    assert any("SortMergeJoin" in plan for _, plan in written) and not [name for name, plan in written if "Broadcast" in plan]


def test_every_jittered_copy_is_found(spark):
    rows = {r["image_id"]: r for r in pixel_queries.QUERIES["jitter_duplicates"](spark, SF).collect()}
    assert all(rows[k]["class_id"] == rows[k + 1]["class_id"] and rows[k]["links"] > 0 for k in rows if k % 2 == 0)
    assert len({r["class_id"] for r in rows.values()}) > 0.9 * len(rows) / 2


def test_pictures_of_any_size(spark):
    rnd = np.random.default_rng(2)
    big = [rnd.integers(0, 256, (h, w, 4)) for h, w in ((40, 31), (200, 120), (3, 5), (1, 1), (9, 64))]
    smooth = [np.stack([128 + 100 * np.sin((np.arange(90)[:, None] * (k + 1) + np.arange(70) * (c + 2)) / (9 + k + c)) for c in range(4)], axis=-1) for k in range(12)]
    rows, jittered = [], []
    for i, p in enumerate([*big, *smooth]):
        rows.append((i, p.shape[1], p.shape[0], bytearray(p.astype(np.uint8).tobytes())))
    images = spark.createDataFrame([*rows, (90, 0, 0, None), (91, *rows[0][1:]), (92, *rows[0][1:])], "image_id long, w int, h int, rgba binary")
    noise = pixels.channel_jitter(pixels.to_pixels(images.filter("w > 6 AND image_id < 90")), 5).withColumn("image_id", F.col("image_id") + 1000)
    both = images.unionByName(pixels.to_images(noise).select("image_id", "w", "h", "rgba"))
    got = {r["image_id"]: r for r in similar.similar_pictures(similar.perceptual_hashes(both)).collect()}
    assert 90 not in got
    assert all(got[i + 1000]["class_id"] == got[i]["class_id"] for i, p in enumerate([*big, *smooth]) if p.shape[1] > 6)
    assert got[91]["hash"] == got[92]["hash"] == got[0]["hash"] and got[0]["links"] == 3 and got[92]["class_id"] == 0
    small = np.repeat(np.repeat(big[3], 8, axis=0), 8, axis=1)[..., :3]
    assert similar.hash_bands(big[3][..., :3]) == similar.hash_bands(small)
    assert similar.similar_pictures(similar.perceptual_hashes(both.limit(0))).count() == 0
