"""Pictures that are equal but for pixel noise: perceptual hashes of image blocks, and a Hamming join by bands.

Hash. Each channel of a picture is reduced to the means of 8 by 8 cells in whole numbers, and these are turned by a
Walsh-Hadamard transform into 64 numbers, the patterns of the picture from coarse to fine. A bit says whether
a pattern is positive. Noise spreads evenly over all patterns, so it turns only bits whose pattern is nearly absent.
Three channels give 192 bits, held as BANDS numbers of 16 bits.

Join. Two hashes of BANDS bands that differ in at most BANDS - AGREE bits agree in AGREE whole bands, so every such pair
meets under a key made of AGREE bands: nothing is missed and nothing is compared without a common key. Pictures of one hash
collapse to one row first, keys that occur once are dropped before any pair is made, and a pair is taken at the
first key at which it meets. Keys of more than SALT_ROWS hashes are dealt over tasks. Every join is told to merge: keys, hashes
and links grow with the pictures, but as Parquet they are a fraction of what they take in memory, so Spark would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.components import connected_components
from frameloom.sources.scratch import keep, materialize, scratch_run

C = F.col
#: Cells of a side, bits of a band, bands of a hash.
CELLS, BAND_BITS, BANDS = 8, 16, 12
#: Bands of a key; hashes within BANDS - AGREE bits are found.
AGREE = 2
#: The unit of cell means, which keeps them whole numbers.
UNIT = 16
#: Hashes of a key from which on its pairs are made by several tasks, and by how many at most.
SALT_ROWS, SALTS = 2_000, 64


def _signs() -> np.ndarray:
    """The 64 patterns as rows of +1 and -1 over the cells."""
    line = np.array([[(-1) ** (u & x).bit_count() for x in range(CELLS)] for u in range(CELLS)])
    return np.einsum("vy,ux->vuyx", line, line).reshape(CELLS * CELLS, CELLS * CELLS)


SIGNS = _signs()


def cell_means(p: np.ndarray) -> np.ndarray:
    """UNIT times the mean of each cell, rounded down: (3, 64) of a picture (h, w, 3). Small pictures repeat pixels."""
    h, w = p.shape[:2]
    ends = [(np.arange(CELLS) * n // CELLS, np.maximum(np.arange(CELLS) * n // CELLS + 1, (np.arange(CELLS) + 1) * n // CELLS)) for n in (h, w)]
    total = np.zeros((h + 1, w + 1, 3), np.int64)
    total[1:, 1:] = p.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    (t, b), (l, r) = ends
    sums = total[np.ix_(b, r)] - total[np.ix_(t, r)] - total[np.ix_(b, l)] + total[np.ix_(t, l)]
    return (sums * UNIT // ((b - t)[:, None] * (r - l)[None, :])[..., None]).reshape(CELLS * CELLS, 3).T


def hash_bands(p: np.ndarray) -> list[int]:
    """The bands of a picture's hash: channel by channel, the first pattern in the lowest bit."""
    bits = (cell_means(p) @ SIGNS.T > 0).reshape(-1, BAND_BITS)
    return (bits @ (1 << np.arange(BAND_BITS))).tolist()


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """(image_id, bands) of images(image_id, w, h, rgba), block by block without a shuffle; null for pictures without pixels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hash_bands(np.frombuffer(r["rgba"], np.uint8).reshape(r["h"], r["w"], 4)[..., :3]) if r["rgba"] else None for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["image_id", "bands"])

    return images.select(C("image_id").cast("long").alias("image_id"), "w", "h", "rgba").mapInArrow(run, "image_id long, bands array<int>")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def hamming_pairs(hashes: DataFrame, within: int, agree: int = AGREE) -> DataFrame:
    """(a, b, distance), a < b, of all rows of hashes(id, bands) that differ in `within` bits or fewer. ids are distinct."""
    if within > BANDS - agree:
        raise ValueError(f"keys of {agree} bands find pairs within {BANDS - agree} bits")
    picks = list(combinations(range(BANDS), agree))

    def packed(pick: tuple[int, ...]) -> Column:
        key = F.lit(0).cast("long")
        for k in pick:
            key = F.shiftleft(key, BAND_BITS).bitwiseOR(C("bands")[k].cast("long"))
        return key

    keyed = hashes.select("id", F.posexplode(F.array(*map(packed, picks))).alias("pick", "key"))
    # Keys that occur once go first, and only what is left of an id's keys is given its bands.
    often = materialize(keyed.groupBy("pick", "key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    salts = F.least(F.lit(SALTS), F.ceil(C("n") / SALT_ROWS)).cast("int")
    met = keyed.join(often.hint("merge"), ["pick", "key"]).select("id", "pick", "key", salts.alias("salts")).join(hashes.select("id", "bands").hint("merge"), "id")
    left = met.select("pick", "key", F.pmod(F.xxhash64("id"), C("salts")).cast("int").alias("salt"), C("id").alias("a"), C("bands").alias("p"))
    right = met.select("pick", "key", F.explode(F.sequence(F.lit(0), C("salts") - 1)).alias("salt"), C("id").alias("b"), C("bands").alias("q"))
    pairs = left.join(right.hint("merge"), ["pick", "key", "salt"]).filter("a < b").withColumn("distance", _distance(C("p"), C("q"))).filter(C("distance") <= within)
    # The first bands in which the two agree are the key at which the pair counts.
    equal = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.get(C("p"), k) == F.get(C("q"), k))
    first = F.array(*(F.array(*map(F.lit, pick)) for pick in picks))
    return pairs.filter(F.slice(equal, 1, agree) == F.get(first, C("pick"))).select("a", "b", "distance")


def similar_pictures(hashes: DataFrame, within: int = BANDS - AGREE) -> DataFrame:
    """(image_id, hash, class_id, links) of hashes(image_id, bands).

    links is the number of other pictures whose hash differs in `within` bits or fewer, class_id the least picture that
    chains of such links reach. Pictures without a hash have no row. What decides is made of distinct hashes: a picture that fills
    a third of the table costs a row for each task.
    """
    with scratch_run(hashes.sparkSession, "similar"):
        named = materialize(hashes.filter(C("bands").isNotNull()).select("image_id", "bands", F.array_join(F.transform("bands", lambda b: F.lpad(F.lower(F.hex(b)), BAND_BITS // 4, "0")), "").alias("hash")), "hashes")
        groups = materialize(named.groupBy("hash").agg(F.min("image_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")), "groups")
        pairs = materialize(hamming_pairs(groups.select("id", "bands"), within), "pairs")
        sizes = groups.select("id", "n")
        both = pairs.select("a", "b").unionByName(pairs.select(C("b").alias("a"), C("a").alias("b")))
        near = both.join(sizes.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(C("a").alias("id")).agg(F.sum("n").alias("near"))
        classes = connected_components(pairs)
        known = groups.join(near.hint("merge"), "id", "left").join(classes.withColumnRenamed("node", "id").hint("merge"), "id", "left")
        known = known.select("hash", F.coalesce("component", "id").alias("class_id"), (C("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
        return keep(named.join(known.hint("merge"), "hash").select("image_id", "hash", "class_id", "links"), "similar")
