"""Digests, sampled fingerprints and duplicate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.fnv import sampled_fingerprint
from frameloom.sources.loose import digest_named, read_loose
from frameloom.sources.scratch import materialize

#: Digest names and the expressions that make them, in the order reports list them.
DIGESTS = {
    "md5": lambda c: F.md5(c),
    "sha1": lambda c: F.sha1(c),
    "sha256": lambda c: F.sha2(c, 256),
    "sha384": lambda c: F.sha2(c, 384),
    "sha512": lambda c: F.sha2(c, 512),
}


def file_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Five uppercase hex digests beside every other column but the content."""
    made = [F.upper(make(F.col(content))).alias(name) for name, make in DIGESTS.items()]
    return files.select(*(c for c in files.columns if c != content), *made)


def duplicate_groups(df: DataFrame, key: str, order: str, size: str = "length") -> DataFrame:
    """Groups of rows that share a key: how many, the newest, and the bytes the others take.

    One aggregate with map-side combining, so a hot key costs a row for each task. Null keys never group.
    """
    return (
        df.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count("*").alias("n"), F.max(order).alias("newest"), (F.sum(size) - F.max_by(size, order)).alias("wasted"))
        .filter("n > 1")
    )


def suspects(prints: DataFrame) -> DataFrame:
    """The rows of prints(..., fingerprint) whose fingerprint another row has, written once."""
    often = prints.filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("_n")).filter("_n > 1")
    return materialize(prints.join(often, "fingerprint", "left_semi"), "suspects")


def confirmed_duplicates(files: DataFrame, key: str, size: str = "length", content: str = "content") -> DataFrame:
    """duplicate_groups by SHA-256 of files(key, size, content), where only suspects are digested.

    A sampled fingerprint names the suspects. They are written without their contents, and the contents are read anew through
    a join with that small table: Spark broadcasts it where its measured size allows, so that no content is shuffled.
    Equal contents have equal fingerprints, so nothing is missed. Keys are distinct; null contents never group.
    """
    prints = files.select(key, size, sampled_fingerprint(content).alias("fingerprint"))
    asked = suspects(prints).select(key)
    digested = files.select(key, size, content).join(asked, key, "left_semi").select(key, size, F.upper(F.sha2(content, 256)).alias("sha256"))
    return duplicate_groups(digested, "sha256", key, size)


def confirmed_loose_duplicates(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(sha256, n, newest, wasted) of loose files with equal contents, newest being the greatest path.

    Every file is listed and sampled; only suspects are opened again, read once in windows, and never held whole.
    """
    prints = read_loose(spark, folder, pattern, "fingerprint").select("path", "length", "fingerprint")
    return duplicate_groups(digest_named(suspects(prints)), "sha256", "path")


def append_suffix(files: DataFrame, main: str, sub: str, seed: int, content: str = "content", path: str = "path") -> DataFrame:
    """Content with a fixed suffix and 8 to 24 bytes that depend on the seed and the path; `added` bytes in all."""
    salt = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(path)).cast("binary"), 256)
    n = 8 + F.conv(F.substring(salt, 1, 2), 16, 10).cast("int") % 17
    fixed = F.encode(F.lit(main + sub), "UTF-8")
    whole = F.concat(F.col(content), fixed, F.unhex(F.substring(salt, F.lit(1), 2 * n)))
    return files.withColumns({content: whole, "added": n + len((main + sub).encode())})


def payload_digest(content: Column, end: Column) -> Column:
    """MD5 of the bytes up to `end`, so that what was appended behind does not count."""
    return F.upper(F.md5(F.substring(content, F.lit(1), end)))
