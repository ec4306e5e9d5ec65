"""Sharding through fixed virtual slots.

Records hash into SLOTS virtual slots for good. Bytes and rows are summed for each slot, which yields a
table of at most SLOTS rows whatever the input. A slot map (version, slot, shard) is a table kept in the
shared folder; rebalancing edits it and writes the next version, so records never rehash: only the slots
that the edit names move. The first version deals the slots out, largest first, to the shard with the
fewest bytes so far (law `bytes`: sizes near equal).

A record's place in its shard needs no global order: a slot's first place is the sum of the rows of the
slots before it in the shard, and places inside a slot come from a window over that slot alone. Only
(id, size, checksum, slot) is shuffled, never a text.

Equal texts of different ids go to different slots: law `bytes` could not hold with a third of all rows in one
shard. A place in a shard is gapless over all its rows.

Skew: a slot holds 1/SLOTS of the records whatever their source or text, as the id and the checksum of
the text are hashed together. Defined cases: a null text has no bytes (size 8, the record's frame) and
checksum 0; a null id is an id like any other; a very long text is one record, its slot being that much larger; repeated rows take places of their own; an empty table
gives an empty result, and a map that deals the slots out evenly; asked for fewer shards than the stored map has, the slots are dealt anew
as a further version; other columns are ignored. Runs over one map folder follow one another.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import entries, exists, materialize, need, scratch_path

SLOTS, FRAME_BYTES = 8192, 8


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: rows (slot, shard, bytes, rows, first), first being the slot's first place in its shard."""

    version: int
    shards: int
    rows: pd.DataFrame

    def save(self, spark: SparkSession, folder: str | None = None) -> str:
        """Write this version beside the others: folder/version=N."""
        folder = folder or scratch_path(spark, "slot-map")
        self.frame(spark).coalesce(1).write.parquet(f"{folder}/version={self.version}")
        return folder

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = self.rows.assign(shards=self.shards)
        return spark.createDataFrame(rows, "slot int, shard int, bytes long, rows long, first long, shards int")

    def loads(self) -> pd.Series:
        return self.rows.groupby("shard")["bytes"].sum().reindex(range(self.shards), fill_value=0)


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version}").orderBy("slot").toPandas()
    # Maps of earlier versions of this module do not say how many shards they have.
    shards = int(rows["shards"].max() if "shards" in rows else rows["shard"].max() + 1) if len(rows) else 0
    return SlotMap(version, shards, rows[["slot", "shard", "bytes", "rows", "first"]])


def latest(spark: SparkSession, folder: str) -> int | None:
    """The last version that was written whole."""
    found = [int(x.rpartition("version=")[2]) for x in entries(spark, folder) if "version=" in x and exists(spark, f"{x}/_SUCCESS")]
    return max(found, default=None)


def _placed(stats: pd.DataFrame) -> pd.DataFrame:
    stats = stats.sort_values(["shard", "slot"], ignore_index=True)
    stats["first"] = stats.groupby("shard")["rows"].cumsum() - stats["rows"]
    return stats[["slot", "shard", "bytes", "rows", "first"]].sort_values("slot", ignore_index=True)


def records(docs: DataFrame, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot."""
    rows = need(docs, key, text)
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    return rows.select(key, (F.length(raw) + FRAME_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(slots)).cast("int"))


def slot_stats(placed: DataFrame, slots: int = SLOTS) -> pd.DataFrame:
    """Bytes and rows of every slot: at most `slots` rows come to the driver."""
    got = placed.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
    return got.set_index("slot").reindex(range(slots), fill_value=0).rename_axis("slot").reset_index()


def build(stats: pd.DataFrame, shards: int) -> SlotMap:
    """Version 1: largest slots first, each to the shard with the fewest bytes (then rows, then slots) so far."""
    heap = [(0, 0, 0, s) for s in range(shards)]
    shard = {}
    for slot, size, n in stats.sort_values(["bytes", "slot"], ascending=[False, True])[["slot", "bytes", "rows"]].itertuples(index=False):
        b, r, k, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (b + size, r + n, k + 1, s))
    return SlotMap(1, shards, _placed(stats.assign(shard=stats["slot"].map(shard))))


def rebalance(old: SlotMap, shards: int, stats: pd.DataFrame | None = None) -> SlotMap:
    """The next version, for as many or more shards or for new stats: slots move only out of shards over
    their fair share, and only into shards under theirs."""
    if shards < old.shards:
        raise ValueError("shards are never taken away by rebalancing")
    rows = old.rows if stats is None else stats.merge(old.rows[["slot", "shard"]], on="slot")
    fair = rows["bytes"].sum() / shards
    shard, load = dict(zip(rows["slot"], rows["shard"], strict=True)), dict.fromkeys(range(shards), 0) | rows.groupby("shard")["bytes"].sum().to_dict()
    for slot, size in rows.sort_values(["bytes", "slot"], ascending=[False, True])[["slot", "bytes"]].itertuples(index=False):
        here, there = shard[slot], min(load, key=lambda s: (load[s], s))
        if load[here] > fair and load[here] - size >= fair * 0.999 and load[there] + size <= fair * 1.001:
            shard[slot] = there
            load[here] -= size
            load[there] += size
    return SlotMap(old.version + 1, shards, _placed(rows.assign(shard=rows["slot"].map(shard))))


def assign(placed: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every record with its shard and its place in the shard, by a map as it is stored. It has a fixed number of rows, so it is broadcast."""
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy(key, "size", "text_crc32")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(slot_map.withColumnRenamed("slot", "vslot")), "vslot").select(
        key, "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).alias("slot"), "vslot", "map_version")


def current(spark: SparkSession, folder: str, stats: pd.DataFrame, shards: int) -> int:
    """The version of the stored map that fits these stats and shards: the last one if it does, else an edit of it; for fewer shards, which no edit
    makes, and for none stored a map dealt anew."""
    last = latest(spark, folder)
    if last is None:
        made = build(stats, shards)
    else:
        old = load_map(spark, folder, last)
        same = old.rows.merge(stats, on=["slot", "bytes", "rows"])
        if old.shards == shards and len(same) == len(stats):
            return last
        made = rebalance(old, shards, stats) if shards >= old.shards else replace(build(stats, shards), version=last + 1)
    made.save(spark, folder)
    return made.version


def shard(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Deal the documents into shards by the map in `folder` (a new folder if none is named), edited where it no longer fits."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "slot-map")
    placed = materialize(records(docs, text, key), "slot-records")
    version = current(spark, folder, slot_stats(placed), shards)
    table = spark.read.parquet(f"{folder}/version={version}").select("slot", "shard", "first", F.lit(version).alias("map_version"))
    return assign(placed, table, key)
