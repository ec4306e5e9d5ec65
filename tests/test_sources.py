"""Readers and writers."""

import numpy as np

from frameloom.functions import png
from frameloom.sources.files import read_files, read_pixels, write_files
from frameloom.sources.loose import write_loose


def test_round_trip(spark, tmp_path):
    rgba = np.random.default_rng(0).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    made = spark.createDataFrame([("a.png", bytearray(png.encode(rgba))), ("b.txt", bytearray(b"text"))], "name string, content binary")
    write_loose(made, str(tmp_path / "loose"))
    files = read_files(spark, str(tmp_path / "loose"), "*.png").collect()
    assert [(r["name"], r["content"]) for r in files] == [("a.png", png.encode(rgba))]
    image = read_pixels(spark, str(tmp_path / "loose")).collect()
    assert [(r["w"], r["h"]) for r in image] == [(5, 3)]
    assert bytes(image[0]["rgba"]) == rgba.tobytes()
    write_files(made, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
