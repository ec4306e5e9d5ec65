"""Fill-in-middle, SentencePiece and whitening against plain versions, with odd rows throughout."""

import hashlib
import random
import re
import time
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from frameloom.llm import fim, pieces, queries, whiten
from oracle import SF, same

SCHEMA = "doc_id long, text string, ids string, n string, form string, w string"
ODD = [None, "", " ", "a", "\n\n", "  two  spaces\t\n", "x" * 900, "naïve café 漢字 😀 á", "word " * 30_000, "same same", "same same", "\x1c\x85　 z", "has <P> in it", "a<S", "P>b<M", "▁ mark▁▁ed", "<s>x</s><0x0A><unk>", "\x00nul\x00", "ſK İ ß"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i if i != 3 else None, t, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


def noise(seed, n, alphabet=" \n\t abcABC019é'!#<>PSM漢字😀\x1c\x85\xa0　▁_"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(n)]


# 11 -- fill in the middle

def plain_fim(text, key):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_a_plain_version(spark):
    for first in (0, 1000):
        df = docs(spark, ODD + noise(1, 300), first)
        keyed = {(r["doc_id"], r["text"]) for r in df.collect()}
        got = fim.fill_in_middle(df).withColumn("back", fim.restored()).collect()
        assert len(got) == len(ODD) + 300
        want = {(k, *plain_fim(t, k), t or "") for k, t in keyed}
        assert {tuple(r) for r in got} == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, key="n")


def test_ranked_bits_by_halving():
    rnd = random.Random(3)
    for width in (1, 63, 64, 65, 1000, 5000):
        bits = rnd.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [fim.ranked_bit(bits, width, k) for k in range(len(places))] == places


def test_a_very_long_text_is_cut_in_little_time():
    text = "ab 1é" * 2_000_000
    began = time.time()
    assert fim.transform(text, "7") == plain_fim(text, 7)
    assert time.time() - began < 60


def test_fill_in_middle_sql(spark):
    same(spark, queries.QUERIES["op11_fill_in_middle"], queries.ORACLE_SQL["op11_fill_in_middle"])


# 12 -- SentencePiece

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(P.path(queries.PIECES)))


def test_pieces_equal_the_library(spark, library):
    texts = ODD + noise(2, 400) + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    df = docs(spark, texts)
    model = pieces.load_model(spark, P.path(queries.PIECES))
    got = pieces.tokens(df, model).collect()
    want = sorted((library.encode(t or ""), library.decode(library.encode(t or ""))) for t in texts)
    assert sorted((list(r["ids"]), r["decoded"]) for r in got) == want
    assert pieces.tokens(df.limit(0), model).count() == 0
    back = pieces.decode(pieces.tokens(df, model, decoded=False), model).collect()
    assert sorted(r["decoded"] for r in back) == sorted(w[1] for w in want)
    with pytest.raises(ValueError):
        pieces.tokens(df, model, keys=("ids",))


def test_digests_of_pieces(spark, library):
    texts = ["hello  world", None, "naïve 漢😀\n"]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.piece_digests(docs(spark, texts), P.path(queries.PIECES)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_very_long_chunks(codec, library):
    rnd = random.Random(5)
    low = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rnd.choice(low) for _ in range(100_000)), "x" * 50_000, " " * 30_001 + "a", "=-" * 20_000, "漢字仮名" * 9000]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.randrange(100, 900))) for a in (low, "ab", "-=", "aé漢", "01 ", "nothei ") for _ in range(20)]
    for t in texts:
        assert codec.segment(" " + t.replace("▁", " ")) == library.encode(t) or " " in t.strip()
    import pyarrow as pa

    flat, counts = codec.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == library.encode(texts)


def test_decoding_of_any_ids(codec, library):
    rnd = random.Random(6)
    some = [*range(3, 259), 259, 260, 300, 29871, 13, 0, 1, 2]
    cases = [[rnd.choice(some) if rnd.random() < 0.8 else rnd.randrange(32000) for _ in range(rnd.randrange(12))] for _ in range(3000)]
    counts = np.array([len(c) for c in cases])
    got = codec.decode(np.array([i for c in cases for i in c], np.int32), counts).to_pylist()
    assert got == [library.decode(c) for c in cases]


# 13 -- whitening

def exact(rows):
    """n, S, x of every row and the covariance by fractions."""
    xs = {k: [int(np.floor(256 * float(np.float32(c)))) for c in v] for k, v in rows}
    fit = sorted(set(map(tuple, xs.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3) for j in range(d)] for i in range(d)]
    return xs, n, s, np.array([[float(c) for c in r] for r in cov])


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "c", 1.0) for k, v in rows], "vec_id long, embedding array<float>, component string, n double")


def test_whitening_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(6, 6))
    good = [(i, (rnd.normal(size=6) @ mix + 50).astype(np.float32).tolist()) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(150)] + [(2000, (-np.zeros(6)).tolist())]
    bad = [(3000, None), (3001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3002, [float("nan")] * 6), (3003, [float("inf")] + [0.0] * 5), (3004, [1.0, 2.0]), (3005, [])]
    xs, n, s, cov = exact(good)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = whiten.whiten(vectors(spark, good + bad)).collect()
    assert len(got) == 4 * len(good) and {r["vec_id"] for r in got} == set(xs)
    sign = {}
    for r in got:
        x, k = xs[r["vec_id"]], r["component"] - 1
        assert r["n"] == n == 302 - 1 and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        want = (np.array([n * a - b for a, b in zip(x, s, strict=True)]) / n) @ v[:, k] / np.sqrt(e[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, np.sign(want * r["whitened"]))
        assert abs(r["whitened"] * sign.get(k, 1) - want) < 1e-9 or abs(want) <= 1e-3
        assert abs(r["explained"] - e[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9


def test_scatter_is_exact_for_large_entries(spark):
    rows = [(i, [float(2**40 + 7 * i), float(-(2**45) + i * i), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = df.select("embedding")
    model = whiten.fit(x)
    xs = [[int(256 * c) for c in v] for _, v in rows]
    n, s = 40, [sum(c) for c in zip(*xs, strict=True)]
    assert model.sums == s and model.n == n
    grid = whiten.whole(df, (), "embedding").distinct()
    y = [[n * a - b for a, b in zip(v, s, strict=True)] for v in xs]
    want = [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    assert whiten._scatter(grid, 3, n, s, max(abs(c) for r in y for c in r)) == want
    got = model.transform(df).collect()
    assert all(r["deviation"] == (t if (t := sum(c * c for c in y[r["vec_id"]])) < 2**63 else None) for r in got)
    assert {r["component"] for r in got} == {1, 2, 3} and all(r["whitened"] is None for r in got if r["component"] == 3)


def test_whitening_of_odd_tables(spark):
    one = whiten.whiten(vectors(spark, [(None, [1.0, 2.0]), (5, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"]) == (1, 0, None, None) for r in one)
    assert whiten.whiten(vectors(spark, [(1, None)])).count() == 0 == whiten.whiten(vectors(spark, [])).count()
    huge = whiten.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4
    with pytest.raises(ValueError):
        whiten.whiten(vectors(spark, []), keys=("component",))


def test_remainders():
    primes = whiten.primes_for(10**40)
    for v in (0, 1, -1, 10**39, -(10**39) + 7):
        assert whiten.remainders_to_number([v % p for p in primes], primes) == v


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_sentencepiece", "op13_whitening"])
def test_new_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
