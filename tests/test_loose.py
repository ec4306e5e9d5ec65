"""The loose-file source and sink, confirmed duplicates, table functions, and what jobs leave behind."""

import hashlib
import os
import pickle
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.functions import fnv, gif, png
from frameloom.operators import container, digest, metadata
from frameloom.sources import loose, table_functions
from test_files import MOVING, PLAIN, files, picture


def made(spark, contents):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in contents.items()], "name string, content binary")


CONTENTS = {"a.bin": b"one", "dir/b.bin": b"two" * 5000, "c ä.txt": b"", "null.bin": None, "big.bin": bytes(range(256)) * 2000}


def test_source_and_sink(spark, tmp_path):
    folder = str(tmp_path / "out")
    loose.write_loose(made(spark, CONTENTS).repartition(3), folder)
    assert sorted(os.listdir(tmp_path)) == ["out"]
    want = {k.rpartition("/")[2]: v or b"" for k, v in CONTENTS.items()}
    got = {r["name"]: r for r in loose.read_loose(spark, folder).collect()}
    assert {k: bytes(r["content"]) for k, r in got.items()} == want
    assert all(r["length"] == len(want[k]) and r["path"] == f"file://{folder}/{k}" and r["modified"] for k, r in got.items())
    assert {r["name"] for r in loose.read_loose(spark, "file://" + folder, "*.bin", "nothing").collect()} == {k for k in want if k.endswith(".bin")}
    prints = {r["name"]: r["fingerprint"] for r in loose.read_loose(spark, folder, holds="fingerprint").collect()}
    assert prints == {k: f"{len(v)}:{fnv.fold([fnv.sampled(v)])[0]:x}" for k, v in want.items()}
    loose.write_loose(made(spark, {"more": b"x"}), folder, mode="append")
    assert loose.read_loose(spark, folder, holds="nothing").count() == len(want) + 1
    loose.write_loose(made(spark, {"only": b"x"}), folder)
    assert os.listdir(folder) == ["only"]


def test_partitions_hold_files_by_bytes(spark, tmp_path):
    folder = str(tmp_path / "out")
    loose.write_loose(made(spark, {f"{i:02}": b"x" * 100 for i in range(20)} | {"large": b"y" * 1000, ".hidden": b"", "_SUCCESS": b""}), folder)
    df = loose.read_loose(spark, folder, partitionBytes="300")
    assert df.rdd.getNumPartitions() == 8
    assert df.count() == 21
    assert loose.read_loose(spark, folder, "none*").count() == 0


def test_listings_hold_what_the_driver_does_not(spark, tmp_path):
    folder = str(tmp_path / "out")
    contents = {f"{i:03}.bin": b"x" * (i % 7) for i in range(50)}
    loose.write_loose(made(spark, contents), folder)
    os.makedirs(f"{folder}/sub/.hidden")
    for name in ("sub/more.bin", "sub/.hidden/no.bin", "sub/_no.bin", ".no.bin"):
        open(f"{folder}/{name}", "w").close()
    os.symlink(f"{folder}/nothing", f"{folder}/broken.bin")
    options = {"path": folder, "partitionBytes": "20"}
    plain = loose.LooseReader(options).partitions()
    listed = loose.LooseReader(options | {"listedAtOnce": "8", "listings": str(tmp_path / "listings")})
    parts = listed.partitions()
    assert len(plain) < len(parts) and len(os.listdir(tmp_path / "listings")) == 7
    assert not any(b".bin" in pickle.dumps(p) for p in parts) and all(b".bin" in pickle.dumps(p) for p in plain)
    assert sorted(f for p in parts for f in p.held()) == sorted(f for p in plain for f in p.files)
    assert all(len(h) <= 8 and (len(h) == 1 or sum(f[1] for f in h) <= 20) for h in (p.held() for p in parts))
    want = {r["path"]: (r["length"], r["modified"], bytes(r["content"])) for r in loose.read_loose(spark, folder).collect()}
    got = loose.read_loose(spark, folder, listedAtOnce="8", partitionBytes="20").collect()
    assert {r["path"]: (r["length"], r["modified"], bytes(r["content"])) for r in got} == want and len(got) == len(want) == 51
    assert loose.read_loose(spark, folder, holds="nothing", recursive="false", listedAtOnce="50").count() == 50
    assert loose.read_loose(spark, folder, "none*", listedAtOnce="1").count() == 0


def test_a_commit_holds_no_task_s_names(tmp_path, monkeypatch):
    class Task:
        def __init__(self, k):
            self.partitionId = self.taskAttemptId = lambda: k

    def wrote(writer, *tasks):
        done = []
        for k, names in enumerate(tasks):
            monkeypatch.setattr(loose.TaskContext, "get", lambda k=k: Task(k))
            done.append(writer.write(iter([pa.RecordBatch.from_pydict({"name": names[i : i + 100], "content": [n.encode() for n in names[i : i + 100]]}) for i in range(0, len(names), 100)])))
        return done

    target = tmp_path / "out"
    target.mkdir()
    (target / "before").write_bytes(b"")
    names = [f"file {i}.bin" for i in range(500)]
    monkeypatch.setattr(loose, "MARKS", 64)
    writer = loose.LooseWriter({"path": str(target)}, True)
    bad = wrote(writer, names, [], names[:3] + ["x/file 7.bin", "alone"])
    assert max(len(pickle.dumps(m)) for m in bad) < 300
    with pytest.raises(ValueError, match="^4 files"):
        writer.commit([*bad, None])
    assert os.listdir(target) == ["before"] and os.listdir(tmp_path) == ["out"]
    with pytest.raises(ValueError, match="^1 files"):
        writer.commit(wrote(writer, ["same", "other", "same"]))
    writer.commit([None, *wrote(writer, names, ["one", "two"], [])])
    assert {p.name: p.read_bytes().decode() for p in target.iterdir()} == {n: n for n in [*names, "one", "two"]}
    assert os.listdir(tmp_path) == ["out"]


def test_samples_of_large_files(tmp_path, monkeypatch):
    monkeypatch.setattr(loose, "WINDOW", 1000)
    from pyarrow import fs

    raw = os.urandom(123_457)
    for n in (0, 1, 63, 4095, 4096, 8191, 8192, 50_000, len(raw)):
        (tmp_path / "f").write_bytes(raw[:n])
        for seek in (1 << 16, 1):
            monkeypatch.setattr(loose, "SEEK", seek)
            with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
                assert loose.sampled_of(f, n).tolist() == fnv.sampled(raw[:n]).tolist()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    loose.write_loose(made(spark, {"a": b"before"}), folder)
    fails = F.when(F.col("id") == 150, F.raise_error(F.lit("no more"))).otherwise(F.col("id").cast("string"))
    bad = spark.range(0, 200, 1, 4).select(fails.alias("name"), F.lit(b"x").alias("content"))
    for df in (bad, made(spark, {"x/same": b"1", "y/same": b"2"}).repartition(2), made(spark, {"": b"1"}), made(spark, {"x/..": b"1"})):
        with pytest.raises(Exception):
            loose.write_loose(df, folder)
        assert os.listdir(folder) == ["a"] and os.listdir(tmp_path) == ["out"]


def test_duplicates_are_confirmed_by_content(spark, tmp_path):
    # Two contents of one fingerprint: they differ between the samples.
    base = bytearray(os.urandom(40_000))
    other = bytearray(base)
    other[1] ^= 255
    contents = {"a": bytes(base), "b": bytes(other), "c": bytes(base), "d": b"alone", "e": b"", "f": b"", "g": None}
    df = made(spark, contents).withColumn("length", F.length("content"))
    assert fnv.fold([fnv.sampled(bytes(base))]) == fnv.fold([fnv.sampled(bytes(other))])
    got = {tuple(r) for r in digest.confirmed_duplicates(df, "name").collect()}
    assert got == {tuple(r) for r in digest.duplicate_groups(digest.file_digests(df).filter("length IS NOT NULL"), "sha256", "name").select("sha256", "n", "newest", "wasted").collect()}
    assert {r[2] for r in got} == {"c", "f"}

    folder = str(tmp_path / "out")
    loose.write_loose(df.filter("content IS NOT NULL"), folder)
    found = {tuple(r) for r in digest.confirmed_loose_duplicates(spark, folder).collect()}
    assert found == {(s, n, f"file://{folder}/{k}", w) for s, n, k, w in got}


def test_only_suspects_are_read_again(spark, tmp_path):
    folder = str(tmp_path / "out")
    loose.write_loose(made(spark, {"a": b"same", "b": b"same", "c": b"other", "d": b"more"}), folder)
    asked = digest.suspects(loose.read_loose(spark, folder, holds="fingerprint").select("path", "fingerprint"))
    for gone in "cd":
        os.remove(f"{folder}/{gone}")
    assert [r["n"] for r in digest.duplicate_groups(loose.digest_named(asked.withColumn("length", F.lit(4))), "sha256", "path").collect()] == [2]
    # In the table form the digest stands above the join with the written suspects, which is broadcast by its size.
    df = made(spark, CONTENTS).withColumn("length", F.length("content"))
    df.write.parquet(str(tmp_path / "table"))
    plan = digest.confirmed_duplicates(spark.read.parquet(str(tmp_path / "table")), "name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(content") < plan.index("Join LeftSemi") and plan.count("suspects") <= 1
    assert hashlib.sha256(b"same").hexdigest().upper() in {r["sha256"] for r in loose.digest_named(asked).collect()}


def test_table_functions_equal_their_dataframe_forms(spark):
    ani = gif.encode([(40, 0, 0, 6, 5, 1, bytes(range(30))), (50, 1, 1, 2, 2, 2, b"abcd"), (0, 0, 0, 6, 5, 0, bytes(30))], 7)
    jpeg = b"\xff\xd8\xff\xfe\x00\x05abc\xff\xe1\x00\x0aExif\0\0II\xff\xda\x00\x02rest"
    text = png.assemble([("IHDR", png.header(1, 1)), ("tEXt", b"k\0v"), ("IEND", b"")])
    df = files(spark, plain=PLAIN, moving=MOVING, ani=ani, jpeg=jpeg, text=text, none=None, empty=b"", cut=jpeg[:9], odd=b"GIF89a")
    df.createOrReplaceTempView("some_files")
    table_functions.register_table_functions(spark, "t_")
    forms = {"png_chunks": container.png_chunks, "jpeg_segments": metadata.jpeg_segments, "exif_tags": metadata.exif_tags, "text_chunks": lambda f: metadata.text_chunks(f).drop("is_important"), "gif_frames": container.gif_frames}
    assert set(forms) == set(table_functions.PARSERS)
    for name, form in forms.items():
        want = form(df)
        got = spark.sql(f"SELECT f.path, r.* FROM some_files f, LATERAL t_{name}(f.content) r")
        assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {(r["screen_w"], r["screen_h"], r["loops"]) for r in container.gif_frames(df).collect()} == {(6, 5, 7)}
    assert [(r["marker"], bytes(r["payload"])) for r in metadata.jpeg_segments(df.filter("path = 'jpeg'")).collect()] == [(0xFE, b"abc"), (0xE1, b"Exif\0\0II")]
    assert picture(2, 2, 0).shape == (2, 2, 4)


def test_nothing_stays_when_an_application_ends(tmp_path):
    code = f"""
import sys
sys.path[:0] = [{os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name in ("write_files", "read_files", "loose_files", "confirmed_duplicates", "jitter_duplicates"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
import os
assert os.listdir({str(tmp_path)!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for _ in range(120):  # Spark's process ends a little after Python's
        if not (left := [f for _, _, names in os.walk(tmp_path) for f in names]):
            break
        time.sleep(0.5)
    assert not left
