"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items fall into size classes: class c holds those of up to 2^c distinct five-word shingles. For class
c a document is cut into blocks of 2^c shingles, and its domains are every two neighbouring blocks, so
an item that stands in a row lies inside one domain whole, and a domain is at most four times the
item's size. That bound turns containment t into a Jaccard similarity of t / (4 + 1 - t) at least, and
the class gets the widest bands that still find such a domain with `RECALL`. Blocks of a class are unions
of two blocks of the class below, so their MinHash values are minima of those already made. A domain that
shares a band with an item makes the pair a candidate, and the pair is verified by the exact containment
of the item's shingles, as words, in the whole document.

Items are a query set: their signatures go to the tasks in blocks of about BLOCK items (some 25 MB) and
BLOCK_BYTES of text, dealt by hash, one pass over the documents for each block. Documents are never shuffled and pairs that share no
band are never made, so hot passages cost a row for each document that holds them.

Defined cases: items of one to four words are one shingle of all their words, so they match only
documents with the same few words; items and documents without words match nothing; null texts are
empty; very long documents and items are searched whole; keys may not bear the name of a result (an error says so);
repeated rows give repeated results; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import need, releasing
from frameloom.llm.shingles import SIZE, WordHashes, multipliers, shingle_hashes, slices, words

HASHES, RECALL, BLOCK, THRESHOLD = 64, 0.99999, 20_000, 0.8
#: Bytes of item texts in a block, about; an item longer than that makes its block longer.
BLOCK_BYTES = 32 << 20
LEAST_CLASS = 3


def band_rows(jaccard: float, hashes: int = HASHES, recall: float = RECALL) -> int:
    """Rows of a band: as many as keep the chance to share a band at `recall`, or one."""
    fit = [r for r in (1, 2, 4, 8) if 1 - (1 - jaccard**r) ** (hashes // r) >= recall]
    return max(fit, default=1)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (bands, columns) of signatures (hashes, columns)."""
    if rows == 1:
        return sig
    out = sig[0::rows].copy()
    for k in range(1, rows):
        out = (out ^ sig[k::rows]) * np.uint64(0x9E3779B97F4A7C15) + (out >> np.uint64(29))
    return out


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float) -> None:
        self.mult = multipliers(HASHES, 7)
        listed = [words(t) for t in texts]
        sh, n = shingle_hashes(*WordHashes()(listed))
        ends = np.cumsum(n)
        self.ids, self.need, self.exact, classes = ids, [], [], []
        sigs = np.zeros((HASHES, len(ids)), np.uint64)
        for i, ws in enumerate(listed):
            mine = np.unique(sh[ends[i] - n[i] : ends[i]])
            self.exact.append({tuple(ws[k : k + SIZE]) for k in range(max(1, len(ws) - SIZE + 1))} if ws else set())
            self.need.append(threshold * len(self.exact[-1]) - 1e-9)
            classes.append(max(LEAST_CLASS, int(np.ceil(np.log2(len(mine))))) if len(mine) else -1)
            if len(mine):
                sigs[:, i] = (mine[None, :] * self.mult[:, None]).min(axis=1)
        self.classes = sorted({c for c in classes if c >= 0})
        self.rows, self.keys, self.owners, self.maybe = {}, {}, {}, {}
        for c in self.classes:
            mine = np.flatnonzero(np.array(classes) == c)
            self.rows[c] = band_rows(threshold / (5 - threshold))
            keys = _bands(sigs[:, mine], self.rows[c])
            order = np.argsort(keys, axis=1)
            self.keys[c], self.owners[c] = np.take_along_axis(keys, order, 1), mine[order]
            self.maybe[c] = np.zeros((len(keys), 1 << 16), bool)
            self.maybe[c][np.arange(len(keys))[:, None], (keys >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, sh: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a band, from the documents' shingles in a row."""
        out: set[tuple[int, int]] = set()
        if not self.classes or not len(sh):
            return out
        c = self.classes[0]
        full = np.flatnonzero(n)
        blocks = -(-n[full] // (1 << c))
        owner = np.repeat(full, blocks)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(n) - n)[owner] + (local << c)
        sig = np.empty((HASHES, len(owner)), np.uint64)
        for k in range(HASHES):
            sig[k] = np.minimum.reduceat(sh * self.mult[k], begin)
        while True:
            if c in self.keys:
                both = np.flatnonzero(owner[1:] == owner[:-1])
                domain = sig.copy()
                domain[:, both] = np.minimum(sig[:, both], sig[:, both + 1])
                keys = _bands(domain, self.rows[c])
                for k, (mine, item_keys, owners) in enumerate(zip(keys, self.keys[c], self.owners[c], strict=True)):
                    hit = np.flatnonzero(self.maybe[c][k][(mine >> np.uint64(48)).astype(np.int64)])
                    low, high = np.searchsorted(item_keys, mine[hit]), np.searchsorted(item_keys, mine[hit], side="right")
                    for h, a, b in zip(hit[high > low], low[high > low], high[high > low], strict=True):
                        out.update((int(owner[h]), int(i)) for i in owners[a:b])
            if c >= self.classes[-1]:
                return out
            c += 1
            keep = np.flatnonzero(local % 2 == 0)
            sig, owner, local = np.minimum.reduceat(sig, keep, axis=1), owner[keep], local[keep] // 2

    def search(self, texts: list[str | None], hashes: WordHashes) -> Iterator[tuple[int, object, int, int]]:
        """(document, item id, shared shingles, the item's shingles) of every verified pair."""
        listed = [words(t) for t in texts]
        found: dict[int, list[int]] = {}
        for d, i in self.candidates(*shingle_hashes(*hashes(listed))):
            found.setdefault(d, []).append(i)
        for d in sorted(found):
            ws = listed[d]
            have = {tuple(ws[k : k + SIZE]) for k in range(max(1, len(ws) - SIZE + 1))}
            for i in sorted(found[d]):
                if (shared := len(self.exact[i] & have)) >= self.need[i]:
                    yield d, self.ids[i], shared, len(self.exact[i])


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", keys: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """keys, item, shared, item_shingles, containment: every document that holds `threshold` of an item's shingles."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    spark = docs.sparkSession
    rows, queries = need(docs, *keys, text), need(items, item, item_text)
    names = [item, "shared", "item_shingles"]
    schema = T.StructType([*(rows.schema[k] for k in keys), queries.schema[item], T.StructField("shared", T.IntegerType()), T.StructField("item_shingles", T.IntegerType())])
    item_type = pa.array([], _arrow(queries.schema[item].dataType)).type

    def passed(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, hashes = Items(*held.value, threshold), WordHashes()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                for at in slices(texts):
                    found = list(known.search(texts[at], hashes))
                    index, *columns = zip(*found, strict=True) if found else [()] * 4
                    where = pa.array([at.start + i for i in index], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(where) for k in keys), *(pa.array(c, t) for c, t in zip(columns, [item_type, pa.int32(), pa.int32()], strict=True))], [*keys, *names])

        return rows.mapInArrow(releasing(run), schema)

    clash = {*keys} & {*names, "containment"}
    if clash:
        raise ValueError(f"keys named as results: {', '.join(sorted(clash))}")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == k)
        got = part.toArrow()  # one block of the stated query set
        held = spark.sparkContext.broadcast((got.column(0).to_pylist(), got.column(1).to_pylist()))
        out = passed(held) if out is None else out.unionAll(passed(held))
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


FIND_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
si AS (SELECT DISTINCT item_id, ws[p : p + 4] AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM i WHERE len(ws) > 0)),
sd AS (SELECT doc_id, ws[p : p + 4] AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, shared::INT AS shared, item_shingles::INT AS item_shingles, shared / item_shingles AS containment
FROM (SELECT doc_id, item_id, count(DISTINCT s) AS shared FROM sd JOIN si USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE shared >= 0.8 * item_shingles - 1e-9"""
