"""Token-ID output in Simple-8b blocks.

A 64-bit word holds a selector in its top four bits and as many ids as fit at the selector's width, from
60 of one bit to one of 60 bits; two selectors stand for runs of 240 or 120 zeros. A value of 60 bits or
more (less one) is an escape: a word of ones, the next word being the value itself. The encoder
takes at each place the selector that packs most ids. Documents start at a word of their own, and a
block carries for each document its key, its number of ids and the offset of its first word: through the offsets
a block decodes as one array, and one document alone (document()).

Files: Parquet parts of blocks (part, block, n_ids, keys, counts, offsets, words). Texts are encoded where they are
read; only their packed words, two thirds of the text, are dealt by ranges of the key and sorted inside, so the
concatenation of the parts is in ascending key order. A bounded number of quantiles of the keys, with even cuts between them,
parts the ranges before anything is encoded, and every part is a task's own. There are as many parts as the texts fill at
PART_BYTES each, whatever the session's settings, and at least the session's shuffle partitions. A document's
global start is the ids of all earlier parts (one row for each part is summed), plus those of earlier documents in
its part.

Skew: ranges follow the key, not the source or the text; equal keys stay together, in the order of
their texts' checksums. Defined cases: null text counts as empty and still gets the end id; null keys
come first, and a key that is no whole number counts as null; a very long text is packed whole and makes a block of its
own size; repeated rows are kept; an empty table gives no blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import need, scratch_path

#: Ids in a word, and bits for each, by selector; selectors 0 and 1 are runs of zeros, 15 is the escape
#: (fixed values of the format; the escape takes the place of the usual single 60-bit value's overflow).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A value of 60 bits or more: the word ESCAPE, then the value. No encoder packs this word otherwise,
#: as its body says one id of 60 bits with all bits set.
ESCAPE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of a block, and what a worker remembers at most.
BLOCK_WORDS, CACHE, PIECES = 65_536, 1_100_000, 300_000
#: Bytes of text encoded at once. Bytes of text of a part.
SLICE, PART_BYTES = 8_000_000, 128 << 20
#: Quantiles of the keys that are asked for at most.
RANGES = 1024
#: Punctuation that makes one piece when it stands behind letters: ASCII without apostrophe and <, |, > of special tokens.
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: The byte-level form: printable bytes stand for themselves, the others for 256, 257, ... in order (fixed rule).
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
BLOCK = "part int, block int, n_ids long, keys array<long>, counts array<int>, offsets array<int>, words binary"


def _fits(ids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For every place the selector that takes most ids, none beyond the document's end (`left` ids from here).

    What fits a selector fits every one of fewer and wider ids, so each test runs only on the places
    that passed the one before.
    """
    n = len(ids)
    best = np.full(n, 15, np.int8)
    at = None
    for s in range(14, -1, -1):
        k, limit = int(COUNTS[s]), np.uint64(1) << np.uint64(WIDTHS[s])
        if at is None:
            small = np.append(ids < limit, np.zeros(k, bool))
            good = left >= k
            for j in range(k):
                good &= small[j : n + j]
            passed = np.flatnonzero(good)
            if 4 * len(passed) < n or s == 9:
                at = passed
        else:
            at = at[left[at] >= k]
            for j in range(k):
                at = at[ids[at + j] < limit]
            passed = at
        if not len(passed):
            break
        best[passed] = s
    return best


def encode(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of several documents, lens ids each, and the words of each document."""
    ids = np.ascontiguousarray(ids, np.uint64)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(ids))
    best = _fits(ids, left)
    steps, places, i, n = COUNTS[best].tolist(), [], 0, len(ids)
    while i < n:
        places.append(i)
        i += steps[i]
    at = np.array(places, np.int64)
    sel = best[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            body = ids[at[mine][:, None] + np.arange(COUNTS[s])]
            shift = (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]))[None, :]
            words[mine] |= np.bitwise_or.reduce((body & np.uint64((1 << 60) - 1)) << shift, axis=1)
    big = ids[at] >= np.uint64((1 << 60) - 1)
    owner = np.searchsorted(ends, at, side="right")
    if big.any():
        wide = np.repeat(np.arange(len(at)), 1 + big)
        second = np.append(False, wide[1:] == wide[:-1])
        words = np.where(second, ids[at][wide], np.where(big[wide], ESCAPE, words[wide]))
        owner = owner[wide]
    return words, np.bincount(owner, minlength=len(lens))


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a run of whole words, and the place of each word's first id (and the end), without a loop over words."""
    words = np.ascontiguousarray(words, np.uint64)
    at = np.arange(len(words))
    ones = words == ESCAPE
    # In a run of such words every second one is the value of the escape before it, and so is what follows an odd run.
    begin = np.maximum.accumulate(np.where(ones & ~np.append(False, ones[:-1]), at, 0))
    mark = ones & ((at - begin) % 2 == 0)
    raw = np.append(False, mark[:-1])[: len(words)]
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(np.where(raw, 1, np.where(mark, 0, COUNTS[sel])))
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    out[ends[raw] - 1] = words[raw]
    for s in range(2, 16):
        mine = np.flatnonzero((sel == s) & ~raw & ~mark)
        if len(mine):
            shift = (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]))[None, :]
            place = (ends[mine] - COUNTS[s])[:, None] + np.arange(COUNTS[s])
            out[place] = (words[mine][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
    return out, np.append(0, ends)


class WordCache:
    """Ids of texts by a tokenizers file whose pieces never hold white space.

    Texts are cut at ASCII white space, and a slice's distinct words found, by Arrow; only those meet Python, are
    encoded once and remembered as packed ids, and Arrow sets them in for every word. A new word of
    letters, with or without ASCII punctuation behind, has its pieces (in the byte-level form that the file's
    pre-tokeniser gives) encoded by the library's model, each distinct piece once; every other word goes
    through the library's whole chain. Both give what the library gives for the text, as tests show.
    """

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", g.ids).tobytes() for g in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-tokenised piece."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            ids = self.pieces[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        return ids

    def _learn(self, new: list[str]) -> None:
        known, met, odd = self.known, self.pieces.get, []
        for t in new:
            core = t.rstrip(PUNCTUATION)
            # Letters, then perhaps ASCII punctuation, are one piece each; words of any other form go through the library whole.
            if not core.isalpha():
                odd.append(t)
                continue
            low = core.lower()
            if not core.isascii():
                if not low.isalpha() or "\u03a3" in core or not unicodedata.is_normalized("NFC", t):
                    odd.append(t)
                    continue
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = met(low) or self._piece(low)
            known[t] = ids if len(core) == len(t) else ids + (met(end := t[len(core) :]) or self._piece(end))
        for k in range(0, len(odd), 4000):
            some = odd[k : k + 4000]
            self.known.update(zip(some, self._whole(some), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE:
                # What these texts hold stays.
                self.known = {w: self.known[w] for w in words if w in self.known}
            self._learn(new)
        ids = list(map(self.known.__getitem__, words))
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        flat = table.take(at).flatten().to_numpy()
        upto = np.append(0, np.cumsum(lens[at.to_numpy()]))
        ends = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        return flat, upto[ends[1:]] - upto[ends[:-1]]


_CACHES: dict[int, WordCache] = {}


def _cache(raw: Broadcast) -> WordCache:
    key = hash(raw.value)
    if key not in _CACHES:
        _CACHES[key] = WordCache(raw.value)
    return _CACHES[key]


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's bytes, a few MB whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their column holds about `most` bytes: the more words at once, the fewer are distinct."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(docs: DataFrame, tokenizer: Broadcast, end_id: int, cuts: Broadcast, text: str = "text", key: str = "doc_id") -> DataFrame:
    """part (by the cuts between keys), key, crc (of the text), n (ids with the end id) and words (packed) of every document."""
    rows = need(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 2, SLICE):
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            # About SLICE bytes at a time, or one text.
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1):
                some = batch.slice(part[0], len(part)) if len(part) else batch.slice(0, 0)
                ids, n = _cache(tokenizer).encode(some.column(2))
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                words, per = encode(ids.astype(np.uint64), n)
                ends = np.append(0, np.cumsum(per) * 8)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words.astype("<u8"))])
                place = np.searchsorted(cuts.value, pc.fill_null(some.column(0), np.iinfo(np.int64).min).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), some.column(0), some.column(1), pa.array(n, pa.int64()), made.cast(pa.binary())], ["part", "key", "crc", "n", "words"])

    given = rows.select(F.col(key).try_cast("long").alias("key"), F.crc32(text).alias("crc"), F.col(text).alias("text"))
    return given.mapInArrow(run, "part int, key long, crc long, n long, words binary")


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, n, words), sorted, to blocks of about BLOCK_WORDS words of one part."""
    block, part = 0, None
    keys: list[int | None] = []
    counts: list[int] = []
    held: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        ends = np.cumsum([len(w) // 8 for w in held])
        offsets = np.append(0, ends[:-1]).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([sum(counts)], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
             pa.array([counts], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int32())), pa.array([b"".join(held)], pa.binary())],
            ["part", "block", "n_ids", "keys", "counts", "offsets", "words"])

    for batch in rows:
        for mine, key, n, w in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if mine != part:
                if keys:
                    yield out()
                part, block, keys, counts, held, size = mine, 0, [], [], [], 0
            keys.append(key)
            counts.append(n)
            held.append(w)
            size += len(w)
            if size >= 8 * BLOCK_WORDS:
                yield out()
                block, keys, counts, held, size = block + 1, [], [], [], 0
    if keys:
        yield out()


def write(docs: DataFrame, tokenizer: Broadcast, end_id: int, path: str, part_bytes: int = PART_BYTES, text: str = "text", key: str = "doc_id") -> None:
    """Encode the texts and write the block files, in ascending key order over ranges of about `part_bytes`."""
    spark = docs.sparkSession
    keys = docs.select(F.col(key).try_cast("long").alias("key"), F.octet_length(text).alias("bytes"))
    total, low, high = keys.agg(F.sum("bytes"), F.min("key"), F.max("key")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // part_bytes), 1)
    held = spark.sparkContext.broadcast(_cuts(keys.select("key"), parts, low, high))  # a number for each part
    rows = packed(docs, tokenizer, end_id, held, text, key).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "crc")
    rows.select("part", "key", "n", "words").mapInArrow(_blocks, BLOCK).write.option("compression", "zstd").parquet(path)


def _cuts(keys: DataFrame, parts: int, low: int | None, high: int | None) -> np.ndarray:
    """Where the keys are cut into parts: at RANGES quantiles at most, read from the keys alone, and evenly between two of them.

    A quantile sketch grows with the number of quantiles, so these are bounded whatever the number of parts.
    """
    if parts < 2 or low is None:
        return np.zeros(0)
    ranges = min(parts, RANGES)
    ends = [low, *keys.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges), high]
    return np.unique(np.interp(np.linspace(0, ranges, parts + 1)[1:-1], np.arange(len(ends)), np.array(ends, np.float64)))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def starts(blocks: DataFrame) -> DataFrame:
    """part -> ids of all earlier parts. One row for each part is summed in order."""
    from pyspark.sql import Window

    total = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def document(blocks: DataFrame, key: int) -> list[list[int]]:
    """The ids of one document (of each of its rows), decoded alone from the words at its offset."""
    found = blocks.filter(F.array_contains("keys", key)).select("part", "block", F.explode(F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.get("keys", i) == key)).alias("i"), "counts", "offsets", "words")
    begin, end = F.get("offsets", F.col("i")), F.coalesce(F.get("offsets", F.col("i") + 1), (F.length("words") / 8).cast("int"))
    rows = found.orderBy("part", "block", "i").select(F.substring("words", begin * 8 + 1, (end - begin) * 8).alias("w"), F.get("counts", F.col("i")).alias("n")).collect()
    return [decode(np.frombuffer(r["w"], "<u8"))[0][: r["n"]].tolist() for r in rows]


def documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode the blocks: key, start, n_tokens, ids_crc32 of every document, in any order."""
    from pyspark.sql import Window

    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_part = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inside"))
    base = in_part.join(starts(blocks), "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))
    shape = f"part int, block int, {key} long, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, places = decode(np.frombuffer(row["words"], "<u8"))
                ids = ids.astype("<u4")
                # A document's ids begin where its first word's do; the last word of the one before may hold fewer than its selector says.
                begins, counts = places[row["offsets"]].tolist(), row["counts"]
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(begins, counts, strict=True)]
                n = len(counts)
                at = list(accumulate(counts, initial=0))[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["keys"], pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "block", key, "at", "n_tokens", "ids_crc32"])

    decoded = blocks.select("part", "block", "keys", "counts", "offsets", "words").mapInArrow(run, shape)
    return decoded.join(base, ["part", "block"]).select(key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, part_bytes: int = PART_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, load_tokenizer(spark, tokenizer_path), end_id, path, part_bytes, text, key)
    return documents(read(spark, path), key)
