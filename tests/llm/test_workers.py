"""What Python workers remember, and what they leave behind."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from frameloom.llm import bpe, common, decontaminate, near_dup, queries, simple8b
from frameloom.llm.common import job_session, release


def made_up(seed, texts, n):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(5, 11))) for _ in range(n)) for _ in range(texts)]


class Frame:
    """Stands for a DataFrame, and gives the function over batches itself."""

    columns, schema = ["doc_id", "text"], {"doc_id": T.StructField("doc_id", T.LongType())}
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run  # noqa: E731, N815


class Held:
    with open(P.path(queries.RANKS), "rb") as f:
        value = f.read()


def test_tokens_leave_no_memory_to_later_stages(monkeypatch):
    codecs = []
    monkeypatch.setattr(bpe, "release", lambda: codecs.append(len(bpe._CODECS)), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b", None]})
    assert [b.num_rows for b in bpe.tokens(Frame(), Held, P.PATTERN, remember=False)(iter([batch]))] == [2]
    assert codecs == [0]  # when all is forgotten
    release()


def test_tokens_that_forget_hold_few_words(monkeypatch):
    most = []
    made = bpe.Codec
    monkeypatch.setattr(bpe, "Codec", lambda raw, pattern, *few: most.append(few) or made(raw, pattern, *few))
    monkeypatch.setattr(bpe, "FEW", 20, raising=False)
    monkeypatch.setattr(bpe, "release", lambda: None)
    texts = made_up(4, 6, 15)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": texts})
    monkeypatch.setattr(bpe, "SLICE", 1)
    got = [x for b in bpe.tokens(Frame(), Held, P.PATTERN, remember=False)(iter([batch])) for x in b.column(b.schema.get_field_index("decoded")).to_pylist()]
    assert [x.decode() for x in got] == texts and most == [(20,)]


def test_stages_before_tokens_leave_no_memory_either(spark, monkeypatch):
    runs, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    near_dup.sketches(docs)
    near_dup._sequences(docs, spark.range(2), "text", "doc_id")
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    for run in runs:
        assert list(run(iter([]))) == []
    assert len(runs) == len(calls) == 2
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    monkeypatch.setattr(frame, "withColumn", lambda self, *_: self)
    decontaminate.find(docs, items)
    assert list(runs[2](iter([]))) == [] and len(calls) == 3


def test_long_rows_go_to_workers_in_small_batches(spark):
    other = job_session(spark.newSession())
    long = other.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS t")
    assert max(r["b"] for r in long.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in bs), "b long").collect()) < 10_000_000
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    assert job_session(other).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m"


@pytest.fixture
def codec():
    with open(P.path(queries.RANKS), "rb") as f:
        return bpe.Codec(f.read(), P.PATTERN)


def test_a_word_is_encoded_and_remembered_once(codec):
    seen, ids = [], codec.ids
    codec.ids = lambda words: seen.extend(words) or ids(words)
    codec.encode(["zebra zebras, (zebra) zebra\nzebra", "zebra, zebras zebras."])
    codec.encode(["zebras zebra, zebra's"])
    assert len(seen) == len(set(seen))
    assert not {" " + c for c in codec.chunks if isinstance(c, str)} & codec.words.keys()


def test_few_remembered_words_change_nothing(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [t.replace("a ", "a, ").replace("b ", "b  ") for t in made_up(2, 30, 25)] + ["", " x", "  y z", "é漢 字,"]
    for k in range(0, len(texts), 3):
        some = texts[k : k + 3] + texts[:1]
        for t, got in zip(some, codec.encode(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == enc.encode_ordinary(t)


def test_full_word_cache_keeps_what_its_texts_hold(monkeypatch):
    with open(P.path(queries.WORD_PIECES)) as f:
        raw = f.read()
    cache, learnt, tok = simple8b.WordCache(raw.encode()), [], Tokenizer.from_str(raw)
    learn = cache._learn
    monkeypatch.setattr(cache, "_learn", lambda new: learnt.extend(new) or learn(new))
    monkeypatch.setattr(simple8b, "CACHE", 30)
    texts = ["the Zebra, " + t for t in made_up(3, 12, 9)] + [None, "", "ΣΑΣ Ünï, K é é. don't <b>!? ...", "the the"]
    for k in range(0, len(texts), 2):
        ids, n = cache.encode(pa.array(texts[k : k + 2], pa.string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 2]]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert learnt.count("Zebra,") == 1
