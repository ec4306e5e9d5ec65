"""The file catalog: keep-latest history, listings, totals, batch summaries, choices and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def sniff_type(content: Column) -> Column:
    """PNG, JPEG or GIF by the first bytes, else null."""
    starts = lambda *magic: reduce(lambda a, b: a | b, (F.substring(content, 1, len(m)) == F.lit(bytearray(m)) for m in magic))
    return F.when(starts(b"\x89PNG\r\n\x1a\n"), "PNG").when(starts(b"\xff\xd8"), "JPEG").when(starts(b"GIF87a", b"GIF89a"), "GIF")


def is_gif(name: Column, mime: Column) -> Column:
    return (mime == "image/gif") | F.lower(name).like("%.gif")


def list_catalog_files(main: DataFrame, other: DataFrame, tag: str, order: str) -> DataFrame:
    """All of the main folder and the tagged pictures of the other one, newest first."""
    name = F.lower("name")
    tagged = other.filter((name.endswith(".png") | name.endswith(".gif")) & F.col("name").contains(tag))
    return main.withColumn("folder", F.lit("main")).unionByName(tagged.withColumn("folder", F.lit("other"))).orderBy(F.desc(order), "folder")


def output_name(position: Column, name: Column, suffix: str, stamp: Column, ext: str) -> Column:
    """Number, base name, suffix and time of a result file."""
    number = F.when(position < 1000, F.lpad(position.cast("string"), 3, "0")).otherwise(position.cast("string"))
    return F.concat(number, F.lit("_"), F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(f"_{suffix}_"), F.date_format(stamp, "yyyyMMddHHmmss"), F.lit(f".{ext}"))


#: Ranges of the order column in which a batch is numbered, and how well they part the rows.
RANGES, RANGE_ERROR = 256, 0.001


def number_batch(files: DataFrame, batch: str, order: str) -> DataFrame:
    """position in the batch by a numeric order column, and badge: the position in batches of two or more.

    The rows of a null batch are one batch. A batch is numbered in RANGES parts of the order column, cut by
    quantiles of all rows, each in a task of its own; a part's first number is the count of its batch's rows in earlier
    parts, summed from one row for each batch and part. So a batch with a third of all rows is no task of its own.
    """
    cuts = sorted(set(files.approxQuantile(order, [k / RANGES for k in range(1, RANGES)], RANGE_ERROR)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = files.withColumns({"_batch": F.struct(batch), "_part": part})
    counts = rows.groupBy("_batch", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_batch")
    before = counts.withColumns({"_before": F.sum("_n").over(w.orderBy("_part")) - F.col("_n"), "_all": F.sum("_n").over(w)}).drop("_n")
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_batch", "_part").orderBy(order)))
    position = (F.col("_before") + F.col("_at")).cast("int")
    return inside.join(before, ["_batch", "_part"]).select(*(F.col(c) for c in files.columns), position.alias("position"), F.when(F.col("_all") > 1, position).alias("badge"))


def history_upsert(history: DataFrame, new: DataFrame) -> DataFrame:
    """The newest record of each (type, dedupe_key); records without a key all stay.

    Records without a key skip the shuffle, and the rest combine on the map side, so neither the many
    nulls nor a hot key meet in one task.
    """
    both = history.unionByName(new)
    keyed = F.coalesce("dedupe_key", F.lit("")) != ""
    rest = [c for c in both.columns if c not in ("type", "dedupe_key")]
    newest = both.filter(keyed).groupBy("type", "dedupe_key").agg(F.max(F.struct("id", *(c for c in rest if c != "id"))).alias("r")).select("type", "dedupe_key", "r.*")
    return both.filter(~keyed).unionByName(newest)


def history_delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id").distinct(), "id", "left_anti")


def history_list(history: DataFrame, n: int) -> DataFrame:
    """The n newest records with a type label and kilobytes."""
    label = F.when(F.col("type") == "click", "restored").when(F.col("type") == "view", "hidden").otherwise("other")
    kb = F.format_string("%.1f KB", F.floor(F.col("size") / 1024 * 10 + 0.5) / 10)
    return history.orderBy(F.desc("id")).limit(n).select("id", "filename", label.alias("label"), kb.alias("kb"))


def history_stats(history: DataFrame) -> DataFrame:
    """Count and bytes by type and in all (type null)."""
    return history.rollup("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def human_size(size: Column) -> Column:
    """Bytes, or one decimal with K to E by 1024; tenths are cut at halves upwards."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate("KMGTPE", 1):
        tenths = F.floor(size / float(1024**i) * 10 + 0.5)
        shown = F.concat((tenths / 10).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}B"))
        out = out.when(size < 1024 ** (i + 1), shown) if unit != "E" else out.otherwise(shown)
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """Done and failed, bytes before and after, and the share saved, by batch."""
    saved = lambda old, new: F.when(old > 0, F.greatest(F.lit(0).cast("long"), js_round((1 - new / old) * 100))).otherwise(F.lit(0).cast("long"))
    done = ~F.col("failed")
    old, new = F.sum(F.when(done, F.col("old_size"))), F.sum(F.when(done, F.col("new_size")))
    return results.groupBy("batch_id").agg(
        F.count_if(done).alias("ok"), F.count_if("failed").alias("failed"), F.coalesce(old, F.lit(0)).alias("bytes_before"), F.coalesce(new, F.lit(0)).alias("bytes_after"),
        F.coalesce(saved(old, new), F.lit(0)).alias("saved_percent"), F.max(F.when(done, saved(F.col("old_size"), F.col("new_size")))).alias("best_percent"))


def pick_under_budget(probes: DataFrame, target: int) -> DataFrame:
    """Per file the largest scale, then the highest quality, whose size fits; else the fallback of scale .3 and quality .1."""
    fit = F.max(F.when(F.col("size") <= target, F.struct("scale", "quality", "size")))
    return probes.groupBy("file_id").agg(fit.alias("p")).select(
        "file_id", F.coalesce("p.scale", F.lit(0.3)).alias("scale"), F.coalesce("p.quality", F.lit(0.1)).alias("quality"), F.col("p.size").alias("size"), F.col("p").isNotNull().alias("fits"))


def hash_report(digests: DataFrame, names: tuple[str, ...] = ("md5", "sha1", "sha256")) -> DataFrame:
    """One block of text for each file: its name and a line for each digest."""
    lines = [F.concat(F.lit(f"{n.upper()}: "), F.col(n)) for n in names]
    return digests.select("file_id", F.concat_ws("\n", "name", *lines).alias("report"))


def tile_order(tiles: DataFrame, name: str = "name") -> DataFrame:
    """Tiles by the number their name starts with; those without come last."""
    number = F.expr(f"try_cast(regexp_extract({name}, '^([0-9]+)', 1) AS BIGINT)")
    return tiles.withColumn("tile_no", number).orderBy(F.asc_nulls_last("tile_no"), name)
