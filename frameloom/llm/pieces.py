"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model whose pieces hold the white-space marker at their front only, no merge joins a character and a marker behind
it. A text, its spaces turned into markers and one set before it, therefore falls into chunks, each a run of markers and
the characters up to the next, that are segmented one by one; characters that stand in no longer piece (line ends, tabs)
are chunks of their own. Chunk boundaries are found on the bytes of many texts at once, the distinct chunks of a slice
make a table, each new one is segmented once in a worker, and ids are joined back by the chunks' positions.

Segmentation contracts the pair of symbols whose joint piece scores highest, the leftmost of equals, until none is
left; symbols that are no pieces fall back to byte pieces. Pairs wait in a heap, so a chunk of any length takes
n log n steps. Decoding gathers the bytes of the pieces; ids that no encoder makes (control pieces, broken UTF-8)
are decoded one by one, as the library does.

The rows stay where they are read: no shuffle, whatever source or word is hot. A worker remembers CHUNKS chunks
at most and then begins anew. Models of another kind (other normalisation, pieces with inner markers, user-defined or unused
pieces) are refused.

Defined cases: a null text is empty and has no ids; a text of spaces only has ids of markers; a marker character in a text is a
space; very long texts and very long chunks are encoded whole; null ids decode to an empty text; an empty table
gives an empty result; extra columns are ignored; keys named as results are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from frameloom.llm.common import need

MARK, UNKNOWN = "▁", " ⁇ "
#: Chunks that a worker remembers, and bytes of text encoded at once.
CHUNKS, SLICE = 600_000, 8_000_000


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a model file, which has a fixed size of some ten thousand pieces."""
    import sentencepiece

    with open(path, "rb") as f:
        digest = hashlib.md5(f.read()).hexdigest()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    kind = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "plain" for i in every]
    probe = sp.encode("  Å Ａ  b ", out_type=str)
    if "".join(p for p in probe if not p.startswith("<0x")).replace("Ａ", "") != f"{MARK * 3}Å{MARK}{MARK * 2}b{MARK}" or kind.count("byte") != 256 or "unused" in kind:
        raise ValueError("the model needs byte pieces, a marker set before the text, and no other normalisation")
    return {"digest": digest, "pieces": [sp.id_to_piece(i) for i in every], "scores": [sp.get_score(i) for i in every], "kinds": kind}


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[starts[k] : starts[k] + counts[k]] one after the other."""
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


class Codec:
    """A model inside one Python worker, and the chunks met so far."""

    def __init__(self, model: dict) -> None:
        pieces, kinds = model["pieces"], model["kinds"]
        plain = [(p, i) for i, p in enumerate(pieces) if kinds[i] == "plain"]
        if any(MARK in p.lstrip(MARK) for p, _ in plain):
            raise ValueError("pieces cross white space")
        self.id_of = dict(plain)
        self.cost = {p: -model["scores"][i] for p, i in plain if len(p) > 1}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
        inner = {c for p, _ in plain if len(p) > 1 for c in p}
        self.alone = np.array([chr(b) not in inner and b < 128 and b != 32 for b in range(256)])
        self.chunks: dict[bytes, np.ndarray] = {}
        self.special = {i: UNKNOWN if k == "unknown" else "" for i, k in enumerate(kinds) if k in ("unknown", "control")}
        self.pieces, self.is_byte = pieces, np.array([k == "byte" for k in kinds])
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k in ("unknown", "control") else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.bytes, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([k == "plain" and p.startswith(MARK) for p, k in zip(pieces, kinds, strict=True)])
        self.odd = np.isin(np.arange(len(pieces)), list(self.special))

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk, in which a space stands for the marker."""
        sym: list[str | None] = list(chunk.replace(" ", MARK))
        n, cost = len(sym), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(cost[s], i, s) for i in range(n - 1) if (s := sym[i] + sym[i + 1]) in cost]
        heapify(waiting)
        while waiting:
            _, i, s = heappop(waiting)
            j = after[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != s:
                continue  # one of the two has been joined with another meanwhile
            sym[i], sym[j] = s, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (t := s + sym[k]) in cost:
                    heappush(waiting, (cost[t], i, t))
            if (h := before[i]) >= 0 and (t := sym[h] + s) in cost:
                heappush(waiting, (cost[t], h, t))
        out: list[int] = []
        for s in sym:
            if s is not None:
                i = self.id_of.get(s)
                out += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        marked = pc.replace_substring(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, "")), MARK, " ")
        sizes = pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        first = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset]
        data = np.frombuffer(marked.buffers()[2], np.uint8)[first : first + ends[-1]]
        space, alone = data == 32, self.alone[data]
        begins = alone | space
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= alone[:-1]
        begins[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(begins)
        table = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, ends[-1]).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct, place = table.dictionary.to_pylist(), table.indices.to_numpy(zero_copy_only=False)
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        held = self.chunks
        for c in distinct:
            if c not in held:
                held[c] = np.array(self.segment(c.decode()), np.int32)
        ids = [held[c] for c in distinct]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        each = counts[place]
        flat = gather(np.concatenate(ids), (np.cumsum(counts) - counts)[place], each)
        upto = np.append(0, np.cumsum(each))
        of = np.searchsorted(at, np.append(0, ends))  # the first chunk of every text
        return flat, np.diff(upto[of])

    def plain_decode(self, ids: list[int]) -> str:
        """One sequence, as the library does: broken bytes are replaced one by one, the first marker goes."""
        out, first, dropped, k = "", True, False, 0
        while k < len(ids):
            if self.is_byte[ids[k]]:
                end = next((j for j in range(k, len(ids)) if not self.is_byte[ids[j]]), len(ids))
                raw = bytes(int(self.bytes[self.starts[i]]) for i in ids[k:end])
                while raw:
                    size = next((m for m in (1, 2, 3, 4) if _valid(raw[:m])), 0)
                    out += raw[:size].decode() if size else "�"
                    raw = raw[max(size, 1) :]
                k = end
                continue
            first = first and not dropped and not out
            piece = self.special.get(ids[k], self.pieces[ids[k]])
            dropped = first and ids[k] not in self.special and piece.startswith(MARK)
            out += piece.removeprefix(MARK if dropped else "").replace(MARK, " ")
            k += 1
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of id sequences that stand one after the other."""
        ends = np.cumsum(counts)
        heads = ends - counts
        sizes, starts = self.sizes[ids], self.starts[ids]
        full = heads[counts > 0]
        cut = full[self.marked[ids[full]]]  # a first marker is no part of the text
        sizes, starts = sizes.copy(), starts.copy()
        sizes[cut] -= 1
        starts[cut] += 1
        upto = np.append(0, np.cumsum(sizes))
        data, offsets = gather(self.bytes, starts, sizes), np.append(0, upto[ends]).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        odd = self.odd[ids]
        if not odd.any():
            try:
                return raw.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        texts = []
        for k, b in enumerate(raw.to_pylist()):
            mine = slice(heads[k], ends[k])
            texts.append(b.decode() if not odd[mine].any() and _valid(b) else self.plain_decode(ids[mine].tolist()))
        return pa.array(texts, pa.string())


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_CODECS: dict[str, Codec] = {}


def _codec(model: Broadcast) -> Codec:
    """One codec for each model in a worker process."""
    key = model.value["digest"]
    if key not in _CODECS:
        _CODECS[key] = Codec(model.value)
    return _CODECS[key]


def load_model(spark: SparkSession, path: str) -> Broadcast:
    """The model's pieces, sent to the executors once."""
    return spark.sparkContext.broadcast(read_model(path))


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE:
            yield begin, i - begin
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes) - begin


def _named(keys: tuple[str, ...], names: tuple[str, ...]) -> None:
    clash = sorted(set(keys) & set(names))
    if clash:
        raise ValueError(f"keys named as results: {', '.join(clash)}")


def _ids(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat, pa.int32()))


def tokens(docs: DataFrame, model: Broadcast, text: str = "text", keys: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """keys, ids (array<int>) and, if asked for, decoded (the text of the ids) of every row."""
    names = ("ids", "decoded") if decoded else ("ids",)
    _named(keys, names)
    rows = need(docs, *keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keys)), "")
            for begin, n in _slices(pc.binary_length(texts).to_pylist()):
                flat, counts = codec.encode(texts.slice(begin, n))
                made = [_ids(flat, counts), *([codec.decode(flat, counts)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, n) for c in batch.columns[: len(keys)]), *made], [*keys, *names])

    kinds = (T.ArrayType(T.IntegerType()), T.StringType())
    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(a, b) for a, b in zip(names, kinds, strict=False))]))


def decode(rows: DataFrame, model: Broadcast, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and decoded of rows that hold ids."""
    _named(keys, ("decoded",))
    rows = need(rows, *keys, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            lists = batch.column(len(keys))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], codec.decode(flat, counts)], [*keys, "decoded"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), T.StructField("decoded", T.StringType())]))
