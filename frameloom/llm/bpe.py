"""Byte-level BPE over a rank vocabulary, with DuckDB recursive queries inside Spark partitions.

Encoding. Each task cuts its texts into the matches of the pre-split pattern and gathers the distinct
ones it has not met before. These go to DuckDB as token-position rows (word, position, token, right
neighbour). A recursive query joins the rows with the merge table, takes for each word the leftmost
pair of minimum rank, contracts it, and stops when no word has a pair left. Texts are then the
concatenation of their words' ids.

A word of any length goes through that query in pieces of PIECE bytes, which would else take as many rounds
as it has tokens. Where pieces meet, the second half of one and the first half of the next are encoded
together. A sequence of tokens is the encoding of its bytes exactly if that holds for every two that stand
side by side (the first merge across a border would also be made if the two stood alone), so it is enough to
test the seams, each distinct pair once by the same query; what fails is encoded again as one, until all hold.

Decoding. Token-position rows join the vocabulary and an ordered string aggregation yields the bytes.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; a very long text
or a very long run of letters is encoded whole, in time that grows with its length. Ids are
packed as little-endian unsigned 32-bit integers in a binary column. Rows are independent: repeated
rows give repeated results, an empty table gives an empty table, and columns other than those named
never reach the Python workers. What counts as a letter or a space follows the Unicode tables of the regex
module; code points that these and tiktoken's tables disagree on (unassigned in Unicode 15) may split otherwise.

Memory of a task is bounded by SLICE characters of text (or one text, if that is longer), ROWS token rows
per DuckDB query and CACHE remembered words.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.common import need, release

#: Characters of text handled at once, token rows per recursive query, remembered words, decoded tokens per query.
SLICE, ROWS, CACHE, TOKENS = 1_500_000, 150_000, 480_000, 300_000
#: Bytes of a piece of a word.
PIECE = 128
#: Remembered words of a codec that is to leave memory to other stages.
FEW = 100_000
#: Punctuation that is one match behind letters: ASCII without the apostrophe of contractions.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

ENCODE_SQL = """
WITH RECURSIVE step AS (
  SELECT s.w, s.pos, s.l, s.r, s.nxt, g.m, false AS done
  FROM sym s LEFT JOIN merges g ON g.l = s.l AND g.r = s.r
  UNION ALL
  SELECT x.w, x.pos, x.l, x.r, x.nxt, g.m, x.done
  FROM (
    SELECT s.w,
           CASE WHEN s.pos = b.nxt THEN b.pos ELSE s.pos END AS pos,
           CASE WHEN s.pos = b.nxt THEN b.m ELSE s.l END AS l,
           CASE WHEN s.nxt = b.pos THEN b.m ELSE s.r END AS r,
           s.nxt, b.m IS NULL AS done
    FROM step s
    JOIN (SELECT w, (key >> 40)::INT AS m, (key >> 20) & 1048575 AS pos, key & 1048575 AS nxt
          FROM (SELECT w, min((m::BIGINT << 40) + (pos << 20) + nxt) AS key FROM step WHERE NOT done GROUP BY w)) b ON s.w = b.w
    WHERE NOT s.done AND s.pos IS DISTINCT FROM b.pos) x
  LEFT JOIN merges g ON NOT x.done AND g.l = x.l AND g.r = x.r
)
SELECT w, l FROM step WHERE done ORDER BY w, pos
"""

DECODE_SQL = """
SELECT t.part, string_agg(v.s, '' ORDER BY t.pos) AS s
FROM tok t JOIN vocab v ON v.id = t.id
GROUP BY t.part ORDER BY t.part
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: (l, r, m), m being that token and its rank."""
    rows = [(a, b, i) for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
    l, r, m = np.array(rows, np.int32).reshape(-1, 3).T
    return pa.table({"l": l, "r": r, "m": m})


class Codec:
    """The vocabulary inside one Python worker: a DuckDB connection and the words met so far."""

    def __init__(self, raw: bytes, pattern: str, most: int | None = None) -> None:
        import duckdb
        import regex

        self.most = most
        self.ranks = read_ranks(raw)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        merges = merge_table(self.ranks)
        self.con.register("m", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "s": [t.decode("latin-1") for t in self.ranks]})
        self.con.register("v", vocab)
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern, self.odd_space, self.cut = regex.compile(pattern), regex.compile(r" (?=\s)| \Z"), regex.compile(r"(?= \S)")
        self.raw = {i: t for t, i in self.ranks.items()}
        # Whether two tokens side by side are the encoding of their bytes.
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str | tuple[str], bytes] = {}

    def _symbols(self, words: list[bytes]) -> pa.Table:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        l = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        pos = (np.arange(len(l)) - np.repeat(ends - lens, lens)).astype(np.int32)
        r = np.append(l[1:], np.int32(-1))
        r[ends - 1] = -1
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos.astype(np.int64), "l": l, "r": r, "nxt": pos.astype(np.int64) + 1})

    def _contracted(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words by the recursive query, ROWS bytes at a time, and where in them each word begins (and the end)."""
        for at in _slices(list(map(len, words)), ROWS):
            part = words[at]
            self.con.register("sym", self._symbols(part))
            got = self.con.sql(ENCODE_SQL).to_arrow_table()
            self.con.unregister("sym")
            yield got["l"].to_numpy().astype("<u4"), np.searchsorted(got["w"].to_numpy(), np.arange(len(part) + 1))

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        return [ids[a:b] for ids, begins in self._contracted(words) for a, b in pairwise(begins.tolist())]

    def _packed(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        return [raw[a:b] for ids, begins in self._contracted(words) for raw in (ids.tobytes(),) for a, b in pairwise((4 * begins).tolist())]

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.raw[i] for i in ids.tolist()])

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of any length."""
        far = [k for k, w in enumerate(words) if len(w) > PIECE]
        if not far:
            return self._packed(words)
        near = [k for k, w in enumerate(words) if len(w) <= PIECE]
        cut = [[words[k][i : i + PIECE] for i in range(0, len(words[k]), PIECE)] for k in far]
        got = iter(self._contract([p for c in cut for p in c]))
        out = dict(zip(near, self._packed([words[k] for k in near]), strict=True))
        out |= {k: np.concatenate(x).tobytes() for k, x in zip(far, self._sewn([[next(got) for _ in c] for c in cut]), strict=True)}
        return [out[k] for k in range(len(words))]

    def _sewn(self, words: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """Ids of the pieces of each word to ids of parts that may stand side by side."""
        halves = [[(x[: len(x) // 2], x[len(x) // 2 :]) for x in w] for w in words]
        over = iter(self._contract([self._bytes(np.concatenate([a[1], b[0]])) for w in halves for a, b in zip(w, w[1:], strict=False)]))
        parts = [[x for x in (w[0][0], *(next(over) for _ in w[1:]), w[-1][1]) if len(x)] for w in halves]
        while True:
            seams = [[(int(a[-1]), int(b[0])) for a, b in zip(w, w[1:], strict=False)] for w in parts]
            new = list({s for w in seams for s in w}.difference(self.fits))
            for s, got in zip(new, self._contract([self.raw[a] + self.raw[b] for a, b in new]), strict=True):
                self.fits[s] = got.tolist() == list(s)
            if all(self.fits[s] for w in seams for s in w):
                return parts
            joined: list[list[list[np.ndarray]]] = []
            for w, ss in zip(parts, seams, strict=True):
                groups = [[w[0]]]
                for x, s in zip(w[1:], ss, strict=True):
                    if self.fits[s]:
                        groups.append([x])
                    else:
                        groups[-1].append(x)
                joined.append(groups)
            again = iter(self._contract([self._bytes(np.concatenate(g)) for w in joined for g in w if len(g) > 1]))
            parts = [[g[0] if len(g) == 1 else next(again) for g in w] for w in joined]

    def _pieces(self, chunk: str) -> list[str]:
        """The matches of the pattern in a chunk; letters, then perhaps ASCII punctuation, need no search."""
        core = chunk.rstrip(PUNCTUATION)
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
            return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
        return self.pattern.findall(chunk)

    def learn(self, new: set[str | tuple[str]]) -> None:
        """Encode the matches of the pattern in new chunks, and remember the chunks. Letters are one match with the space before
        them, so such a match is remembered as its chunk alone; `words` has the others."""
        chunks, words = self.chunks, self.words
        plain = {c for c in new if c.__class__ is str and c.isalpha()}
        split = {c: self._pieces(" " + c if isinstance(c, str) else c[0]) for c in new.difference(plain)}
        every = set(chain.from_iterable(split.values()))
        spaced = {p for p in every if p[0] == " " and p[1:].isalpha()}
        plain.update([c for p in spaced if (c := p[1:]) not in chunks])
        if len(self.fits) > (self.most or CACHE):
            self.fits.clear()
        todo = every.difference(spaced, words)
        if len(words) + len(todo) > (self.most or CACHE):
            words.clear()
            todo = every.difference(spaced)
        got = iter(self.ids([*((" " + c).encode() for c in plain), *(p.encode() for p in todo)]))
        chunks.update(zip(plain, got))
        words.update(zip(todo, got, strict=True))
        for c, ps in split.items():
            chunks[c] = b"".join([chunks[p[1:]] if p in spaced else words[p] for p in ps])

    def split(self, text: str) -> list[str | tuple[str]]:
        """Chunks of a text such that no match of the pattern crosses a cut: a single space before a
        character that is no space starts a new match, so a cut before it is safe. A string stands for
        itself with a space before it, a tuple of one for a chunk as it is."""
        if not text:
            return []
        if self.odd_space.search(text):
            return [c[1:] if k else (c,) for k, c in enumerate(self.cut.split(text)) if c]
        parts = text.split(" ")
        parts[:1] = [(parts[0],)] if parts[0] else []
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        met = set().union(*parts)
        new = met.difference(self.chunks)
        if new:
            if len(self.chunks) + len(new) > (self.most or CACHE):
                # What these texts hold stays.
                self.chunks = {c: self.chunks[c] for c in met.difference(new)}
            self.learn(new)
        known = self.chunks.__getitem__
        return [b"".join(map(known, p)) for p in parts]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of packed ids; TOKENS token rows go to a query, and a longer text takes several parts."""
        lens = [len(p) // 4 for p in packed]
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        out: list[list[str]] = [[] for _ in packed]
        owner = np.repeat(np.arange(len(packed), dtype=np.int32), lens)
        for k in range(0, len(ids), TOKENS):
            part = owner[k : k + TOKENS]
            self.con.register("tok", pa.table({"part": part, "pos": np.arange(len(part), dtype=np.int32), "id": ids[k : k + TOKENS]}))
            for i, s in self.con.execute(DECODE_SQL).fetchall():
                out[i].append(s)
            self.con.unregister("tok")
        return ["".join(x).encode("latin-1") for x in out]


_CODECS: dict[tuple, Codec] = {}


def _codec(raw: Broadcast, pattern: str, most: int | None = None) -> Codec:
    """One codec for each vocabulary in a worker process."""
    key = (hash(raw.value), pattern, most)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw.value, pattern, most)
    return _CODECS[key]


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _mapped(df: DataFrame, column: str, empty: str | bytes, work: Callable[[list], tuple[list[bytes], ...]], names: tuple[str, ...], remember: bool) -> DataFrame:
    """Replace a column by binary ones, slice by slice."""
    keep = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            rest = batch.select(keep)
            for at in _slices(pc.fill_null(pc.binary_length(values), 0).to_pylist(), SLICE):
                n = at.stop - at.start
                made = work([x if x is not None else empty for x in values.slice(at.start, n).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rest.slice(at.start, n).columns, *(pa.array(x, pa.binary()) for x in made)], [*keep, *names])
        if not remember:
            _CODECS.clear()
            release()

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *(T.StructField(x, T.BinaryType()) for x in names)]))


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes, sent to the executors once (some hundred kB, the size of the vocabulary)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: Broadcast, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), remember: bool = True) -> DataFrame:
    """keys and ids (binary, little-endian unsigned 32-bit) for every row; null texts count as empty."""
    return _mapped(need(df, *keys, text), text, "", lambda v: (_codec(vocabulary, pattern).encode(v),), ("ids",), remember)


def decode(df: DataFrame, vocabulary: Broadcast, pattern: str, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), remember: bool = True) -> DataFrame:
    """keys and decoded (binary) for every row of packed ids; null ids count as none."""
    return _mapped(need(df, *keys, ids), ids, b"", lambda v: (_codec(vocabulary, pattern).decode(v),), ("decoded",), remember)


def tokens(df: DataFrame, vocabulary: Broadcast, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), remember: bool = True) -> DataFrame:
    """Round trip in one worker: keys, ids, decoded. Workers keep the words they met for later tasks, unless told to forget them at the end of each;
    then they also hold FEW at once."""
    most = None if remember else FEW

    def both(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        codec = _codec(vocabulary, pattern, most)
        ids = codec.encode(texts)
        return ids, codec.decode(ids)

    return _mapped(need(df, *keys, text), text, "", both, ("ids", "decoded"), remember)
