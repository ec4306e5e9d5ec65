"""Near duplicates by Order MinHash with verification by banded alignment.

Sketches. A text's five-word shingles are labelled with their occurrence number, and each of SKETCHES
hash functions keeps the two labelled shingles of least hash, in text order. Texts share such a pair
with a chance that falls with every edit and with every change of order, which is what edit similarity
measures. Links. Two texts are linked when a banded alignment of their words shows an edit similarity
(1 - distance / words of the longer) of THRESHOLD or more; one shared sketch is enough to be aligned, and
nothing else is asked. Classes are the connected components of links and equal texts.

How pairs are kept few. Equal texts collapse to the least id first and are not compared again. Texts that
share a sketch form a bucket, and each is compared with the bucket's most central member: the one
whose sketches are shared most widely, as the original of many copies is. Texts of buckets whose members are
not all in one component then are dealt again by pairs of sketches, which texts that only share a passage seldom have in
common, and compared with those buckets' centres. A deal costs a row for each member, never a bucket's pairs.
What decides is therefore whether two near duplicates, or texts linked to them, ever meet at a centre: with SKETCHES
sketches they share some that no third text has, unless nearly all they have in common is common to many. The tests
and the README give measured recall.

Skew: keys of more than SALT_ROWS rows are salted on both sides of a join (salted_join), so a hot bucket, a large
group of copies or of near copies costs a row for each member, dealt over many tasks. Words travel only for texts
in a pair. Defined cases: a text without words is equal to texts of the same characters and near none; null texts
are equal to one another; texts of one to four words are one shingle; very long texts are sketched and aligned whole;
a row without an id is compared with equal texts only and gets their least id, null if none has one; repeated ids
with the same text fall together, and of an id's different texts one is aligned; of centres of equal weight the least
id stands; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import discard, keep, materialize, need, releasing, scratch_run
from frameloom.llm.shingles import WordHashes, multipliers, shingle_hashes, slices, words

#: At the threshold, where a fifth of the words is replaced at random, a pair shares a sketch with a chance of 0.91 (texts of 60 words) to
#: 0.98 (300 words), at 0.9 with one of 0.999 and more.
SKETCHES, THRESHOLD, SALT_ROWS = 96, 0.8, 2000
#: The partners of a sketch when texts are dealt again by pairs.
NEXT = 3
#: Bits of the map that tells which texts are asked for.
BITS = 1 << 22


def labelled(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shingles of several texts in a row, each mixed with the number of its occurrence in its text."""
    owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
    order = np.lexsort((sh, owner))  # stable, so equal shingles stay in text order
    s, o = sh[order], owner[order]
    new = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])) if len(sh) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    label = np.empty(len(sh), np.uint64)
    label[order] = (np.arange(len(sh)) - run).astype(np.uint64)
    return sh ^ (label * np.uint64(0xD6E8FEB86659FD93))


def order_min_hash(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sketch keys (texts, SKETCHES) of shingles in a row; texts must have one shingle at least."""
    begins = np.cumsum(n) - n
    known = labelled(sh, n)
    place = np.arange(len(sh), dtype=np.uint64)
    # Low bits of a hash, which give way to the shingle's place.
    low = np.uint64((1 << max(24, len(sh).bit_length())) - 1)
    out = np.empty((len(n), SKETCHES), np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.empty(len(sh), np.uint64)
    for j, m in enumerate(multipliers(SKETCHES, 11)):
        # The upper bits order the shingles, the lower ones tell which it is.
        np.multiply(known, m, out=h)
        np.bitwise_and(h, ~low, out=h)
        np.bitwise_or(h, place, out=h)
        a = (np.minimum.reduceat(h, begins) & low).astype(np.int64)
        h[a] = top
        least = np.minimum.reduceat(h, begins)
        b = np.where(least == top, a, (least & low).astype(np.int64))
        one, two = known[np.minimum(a, b)], known[np.maximum(a, b)]
        out[:, j] = ((one * np.uint64(0x9E3779B97F4A7C15) + (two ^ (one >> np.uint64(29)))) * m + np.uint64(j)).view(np.int64)
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance (insert, delete, substitute) of two word sequences, or most+1 if it is larger.

    Common ends are cut off. Of the alignment's table only the cells within `most` of the diagonal are
    filled, a column at a time: whether a cell is one more or one less than the cell above it, or than its
    left one, is a bit, and a column of the band is one whole number (bit-parallel alignment). The
    distance is followed along the diagonal that ends in the last cell, where it never falls.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    k = n if same.all() else int(np.argmin(same))
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    k = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not len(b):
        return len(a)
    # Bit i + most of places[w] says that word i of a is w; shifted by the column, bit `most` is the diagonal.
    places: dict[int, int] = dict.fromkeys(b.tolist(), 0)
    for i, w in enumerate(a.tolist()):
        if w in places:
            places[w] |= 1 << (i + most)
    full = (1 << (2 * most + 1)) - 1
    more, less = full >> most << most, 0  # above the first row there is nothing
    end = 1 << (len(a) - len(b) + most)
    distance = len(a) - len(b)
    for j, w in enumerate(b.tolist()):
        hit = (places[w] >> j) & full
        free = (((hit & more) + more) ^ more) | hit | less  # the diagonal step into the cell costs nothing
        right = (less | ~(free | more)) & full  # one more than the left cell
        left = free & more
        if not free & end:
            distance += 1
            if distance > most:
                return most + 1
        ahead = (free & full) >> 1
        more = (left | ~(ahead | right)) & full
        less = ahead & right
    return distance


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sequences of word hashes are near duplicates."""
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) <= most


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, same (the text's MD5, null for null) and sketch (array of SKETCHES keys, null for texts without words) of every row."""
    rows = need(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in slices(texts):
                sh, n = shingle_hashes(*hashes([words(t) for t in texts[at]]))
                full = np.flatnonzero(n)
                made = order_min_hash(sh, n[full]) if len(full) else np.empty((0, SKETCHES), np.int64)
                ends = np.append(0, np.cumsum(np.where(n > 0, SKETCHES, 0))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(n == 0, False)), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at.start, at.stop - at.start) for i in (0, 1)), keys], ["id", "same", "sketch"])

    given = rows.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("same"), text)
    return given.mapInArrow(releasing(run), "id long, same binary, sketch array<long>")


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str = "id", value: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with table (key, n, ...), n being the rows of a key; or with value (key, ...) for the keys of table.

    Keys of more than SALT_ROWS rows are dealt over several. The table is written first and the hot keys are read from it
    (rows / SALT_ROWS of them at most), so it is made once, and Spark knows sizes when it chooses how to join.
    """
    table = materialize(table, "keys")
    hot = materialize(table.filter(F.col("n") > SALT_ROWS).select(key, F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("_salts")), "hot")
    right = table.drop("n") if value is None else value
    if hot.isEmpty():
        return rows.join(right, key)
    left = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    right = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _marks(ids: DataFrame) -> np.ndarray:
    """A map of BITS bits with those of the ids' hashes set: it comes to the driver in 128 rows of 4 kB, whatever the input."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS))
    rows = ids.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    # Buckets count from 1 for the numbers 1 to 32768; number 0 is bucket 0's.
    out = np.zeros(BITS // 32768 + 2, dtype="(4096,)u1")
    for r in rows:
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sequences(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """id, seq (the hashes of all words, four bytes each) of the wanted ids.

    A bit map lets the other texts go before the shuffle; where ids are too many for it, more pass, and the
    join decides.
    """

    def run(texts: list[str], hashes: WordHashes) -> list[pa.Array]:
        listed, lens = hashes([words(t) for t in texts])
        return [pa.array([(listed[e - n : e] >> np.uint64(32)).astype("<u4").tobytes() for e, n in zip(np.cumsum(lens), lens, strict=True)], pa.binary())]

    return _of_wanted(docs, wanted, text, key, run, "seq binary").join(wanted, "id", "left_semi")


def _of_wanted(docs: DataFrame, wanted: DataFrame, text: str, key: str, made: Callable[[list[str], WordHashes], list[pa.Array]], schema: str) -> DataFrame:
    """id and what `made` makes of the text, for the wanted ids and the few others that the bit map lets pass."""
    held = docs.sparkSession.sparkContext.broadcast(_marks(wanted))
    bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, marks = WordHashes(), held.value
        for batch in batches:
            bucket, at = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            keep = pa.array(np.flatnonzero(marks[bucket, at // 8] >> (at % 8).astype(np.uint8) & 1))
            ids, texts = batch.column(0).take(keep), batch.column(3).take(keep).to_pylist()
            for part in slices(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, part.stop - part.start), *made(texts[part], hashes)], names)

    passed = docs.select(F.col(key).cast("long").alias("id"), F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"), text).filter("id IS NOT NULL")
    return passed.mapInArrow(releasing(run), f"id long, {schema}")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (id, centre) that are near duplicates, written. Words are fetched for the texts in them only; hot centres are salted."""
    wanted = materialize(pairs.select("id").unionAll(pairs.select("centre")).distinct(), "wanted")
    sequences = materialize(_sequences(docs, wanted, text, key).dropDuplicates(["id"]), "words")
    centres = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    held = centres.select("centre").join(sequences.select(F.col("id").alias("centre"), F.col("seq").alias("other")), "centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if similar(np.frombuffer(batch.column(2)[i].as_py(), "<u4"), np.frombuffer(batch.column(3)[i].as_py(), "<u4"))]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    both = salted_join(pairs.join(sequences, "id"), centres, "centre", value=held)
    links = materialize(both.select("id", "centre", "seq", "other").mapInArrow(releasing(run), "id long, centre long"), "links")
    discard(sequences)
    discard(wanted)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each node's connected component, for nodes with an edge.

    Alternates two steps until nothing changes: every node's larger neighbours are joined to its least
    neighbour, then every node itself. Each round writes its edges to the checkpoint folder. A hub's rows are salted.
    """
    now = materialize(edges.select(F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = salted_join(both, low, "u", by="v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low, "u", by="v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        then = materialize(small, "edges")
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(then) == mark(now):
            return then.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").unionAll(then.select("v", "v").distinct().toDF("id", "root")).groupBy("id").agg(F.min("root").alias("root"))
        now = then


def _centred(members: DataFrame) -> DataFrame:
    """(id, centre) of buckets (id, weight, bucket): everyone with the bucket's weightiest member, least id first."""
    centre = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"))).alias("c"), F.count("*").alias("n")).filter("n > 1")
    centre = centre.select("bucket", "n", (-F.col("c.less")).alias("centre"))
    return salted_join(members, centre, "bucket").filter("id <> centre").select("id", "centre").distinct()


def _split(rooted: DataFrame) -> DataFrame:
    """The rows (id, weight, bucket, root) of buckets whose members are in several components."""
    split = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).filter("a <> b").select("bucket", "n")
    return salted_join(rooted, split, "bucket")


def _by_pairs(member: DataFrame, ids: DataFrame) -> DataFrame:
    """The members (id, weight, at, bucket) of these ids, dealt by two buckets each: one and the NEXT ones behind it, going round."""
    held = member.join(ids, "id", "left_semi").groupBy("id", "weight").agg(F.map_from_entries(F.collect_list(F.struct("at", "bucket"))).alias("b"))
    of = lambda at: F.try_element_at("b", at)
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit((i + k) % SKETCHES).alias("j")) for i in range(SKETCHES) for k in range(1, NEXT + 1)))
    dealt = held.select("id", "weight", "b", F.explode(places).alias("p")).select("id", "weight", of(F.col("p.i")).alias("x"), of(F.col("p.j")).alias("y"))
    return dealt.filter("x IS NOT NULL AND y IS NOT NULL").select("id", "weight", F.xxhash64("x", "y").alias("bucket"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id for every row: the least id among the texts that are equal to or linked with this one."""
    rows = need(docs, key, text).withColumn(key, F.col(key).cast("long"))
    with scratch_run(docs.sparkSession, "near-duplicates"):
        return keep(_classes(rows, text, key), "classes")


def _classes(rows: DataFrame, text: str, key: str) -> DataFrame:
    made = materialize(sketches(rows, text, key).withColumn("same", F.coalesce("same", F.lit(b""))), "sketches")
    least = made.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = materialize(salted_join(made.select("id", "same"), least, "same").select("id", "first"), "copies")
    # Of equal texts one sketch goes on; then buckets of two or more texts, and how widely each text's sketches are shared.
    firsts = made.filter("id IS NOT NULL AND sketch IS NOT NULL").groupBy("same").agg(F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch"))
    every = materialize(firsts.select("id", F.posexplode("sketch").alias("at", "bucket")), "members")
    discard(made)
    sized = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    shared = materialize(salted_join(every, sized, "bucket"), "buckets")
    discard(every)
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    member = materialize(shared.join(weight, "id").select("id", "weight", "at", "bucket"), "weighed")
    discard(shared)
    pairs = materialize(_centred(member), "pairs")
    links = _verified(pairs, rows, text, key)
    roots = materialize(components(links), "roots")
    root = F.coalesce("root", "id").alias("root")
    open_ = materialize(_split(member.join(roots, "id", "left").select("id", "bucket", root)).select("id").distinct(), "open")
    if not open_.isEmpty():
        dealt = _by_pairs(member, open_).join(roots, "id", "left").select("id", "weight", "bucket", root)
        dealt = materialize(dealt, "dealt")
        more = materialize(_centred(_split(dealt).drop("root")).join(pairs, ["id", "centre"], "left_anti"), "pairs")
        discard(dealt)
        links = links.unionAll(_verified(more, rows, text, key))
        roots = materialize(components(links), "roots")
    members = copies.groupBy("first").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("id", "first"), "first", "left").select("first", "n", F.coalesce("root", "first").alias("class_id"))
    named = salted_join(copies.filter("first IS NOT NULL"), members, "first")
    lone = copies.filter("first IS NULL").select("id", F.col("first").alias("class_id"))
    return named.select("id", "class_id").unionAll(lone).select(F.col("id").alias(key), "class_id")
