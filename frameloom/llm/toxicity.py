"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicon. From labelled training rows: for each word and each word beginning of 4 to 6 letters, the
documents of either label that hold it are counted by one aggregation, and the terms whose smoothed
log-odds stand out are kept, LEXICON at most. A short list of English insults is there before any label. The rows that
the trees learn from fall into halves, and the features of each half use the lexicon of the other, so that no row
is measured by terms that its own label brought in; what is scored later uses the lexicon of both.

Features, each a density or a share, so that length does not matter by itself: lexicon hits in all and of
the strong part, the largest weight, hits close to a second-person word, capitals, words in capitals,
exclamation and question marks, other punctuation, masked words (letters broken by digits or symbols),
spelled-out words (runs of single letters), stretched letters, digits, mean word length.

Model. GBTClassifier fits the features of a sample of labelled rows: SAMPLE rows at most, those of least
hash, whatever the size of the input. Every fourth of them (by hash) is kept apart from the lexicon and the trees and
fits the isotonic calibration of their raw scores (if all of these have one label, the share of label 1 stands in for
it). Between the middles of two steps of the isotonic fit a score goes straight from one step's height to the next's,
so that scores still rank. Scoring covers every row: the features are made in Arrow batches from which only numbers
come back; trees and calibration run in the JVM.

Skew: texts are never shuffled; counts for the lexicon are combined before the shuffle. Defined cases:
null and empty texts have all features 0 and get the calibrated score of that; very long texts are read whole; repeated rows score alike;
with no labelled rows, or labels of one kind only, the score is the share of label 1 among them (0
without any); an empty table gives an empty result; label rows with a null id or label are left out;
repeated labels of an id count once, the larger label standing; other columns are ignored, and lang,
source, ids and labels are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, need, scratch_run

#: The most labelled rows that a fit reads, the most terms of the lexicon, trees, their depth.
SAMPLE, LEXICON, TREES, DEPTH = 12_000, 400, 16, 3
#: Insults known before any label, and second-person words of the four languages (fixed word lists).
SEEDS = ("idiot", "stupid", "moron", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros du dich dir dein deine deinen ihr euch euer sie".split())
FEATURES = ("hits", "strong", "best", "near_you", "capitals", "shouted", "marks", "punctuation", "masked", "spelled", "stretched", "digits", "word_length")

TOKEN = re.compile(r"[^\W_]+")
LOOSE = re.compile(r"\S+")
MASKED = re.compile(r"[^\W\d_][@$!*0-9#%&]+[^\W\d_]")
SPELLED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
MARKS, PUNCTUATION = re.compile(r"[!?]"), re.compile(r"[^\w\s]")
#: Digits and symbols read as letters in masked words (fixed table).
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "%": "", "&": ""})
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
#: Remembered words, words between a hit and a second-person word, log-odds from which a hit is strong.
CACHE, NEAR, STRONG = 150_000, 4, 3.0
#: The log likelihood ratio a term must reach.
EVIDENCE = 18.0


def terms(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a star."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


class Lexicon:
    """Weights of terms; a word weighs as much as its heaviest term."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.known = weights, {}

    def __call__(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[word] = max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)
        return got

    def features(self, text: str | None) -> list[float]:
        """The values of FEATURES."""
        if not text:
            return [0.0] * len(FEATURES)
        words = TOKEN.findall(text.lower())
        n, chars = max(1, len(words)), len(text)
        known = self.known
        weights = [known[w] if w in known else self(w) for w in words]
        masks = MASKED.findall(text) and [w for w in LOOSE.findall(text) if MASKED.search(w)]
        hidden = [self(x) for w in masks or () for x in TOKEN.findall(w.lower().translate(UNMASK))]
        spelled = SPELLED.findall(text) and [m[0] for m in SPELLED.finditer(text)]
        hidden += [self("".join(TOKEN.findall(x.lower()))) for x in spelled or ()]
        hit = [i for i, w in enumerate(weights) if w > 0]
        near = sum(1 for i in hit if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
        found = [weights[i] for i in hit] + [w for w in hidden if w > 0]
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        loud = len(SHOUTED.findall(text)) if upper > 3 else 0
        return [
            len(found) / n, sum(1 for w in found if w >= STRONG) / n, max(found, default=0.0), near / n, upper / chars, loud / n, len(MARKS.findall(text)) / n,
            len(PUNCTUATION.findall(text)) / n, len(masks or ()) / n, len(spelled or ()) / n, len(STRETCHED.findall(text)) / n, sum(map(str.isdigit, text)) / chars, sum(map(len, words)) / n,
        ]


def _features(lexicons: Broadcast):
    """A column function of (text, which lexicon): the values of FEATURES."""
    known: dict[int, Lexicon] = {}

    def run(texts: pa.Array, which: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts.to_pylist(), which.to_pylist(), strict=True):
            if k not in known:
                known[k] = Lexicon(lexicons.value[k])
            out.append(known[k].features(t))
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"texts": pa.Array, "which": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")


def mine_lexicons(sample: DataFrame, text: str, label: str, half: str = "half", most: int = LEXICON) -> list[dict[str, float]]:
    """Terms and their log-odds from the rows of half 0, of half 1 and of both. `most` terms of each come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4))], ["term", "a0", "b0", "a1", "b1"])
            counts.clear()
            return out

        for batch in batches:
            for t, y, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for x in {x for w in set(TOKEN.findall((t or "").lower())) if not w.isdigit() for x in terms(w)}:
                    counts.setdefault(x, [0, 0, 0, 0])[2 * h + 1 - y] += 1
                if len(counts) > CACHE:
                    yield flush()
        yield flush()

    names = ("a0", "b0", "a1", "b1")
    totals = {r["half"]: (int(r["pos"] or 0), int(r["n"])) for r in sample.groupBy(F.col(half).alias("half")).agg(F.sum(label).alias("pos"), F.count("*").alias("n")).collect()}
    counted = sample.select(text, F.col(label).cast("int"), F.col(half).cast("int")).mapInArrow(run, "term string, a0 long, b0 long, a1 long, b1 long")
    counted = materialize(counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)), "toxicity-terms")
    out = []
    for halves in ((0,), (1,), (0, 1)):
        pos, n = (sum(totals.get(h, (0, 0))[i] for h in halves) for i in (0, 1))
        if not 0 < pos < n:
            out.append(dict.fromkeys(SEEDS, 6.0))
            continue
        some = counted.select("term", *(reduce(add, (F.col(f"{c}{h}") for h in halves)).alias(c) for c in "ab"))
        odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (n - pos + 1))
        # Twice the log likelihood ratio of the term's counts against chance, so that rare words need not be lucky only.
        plain = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)
        some = some.withColumn("g2", 2 * (plain("a", pos / n) + plain("b", (n - pos) / n)))
        best = some.filter((F.col("a") >= max(3, pos // 400)) & (F.col("g2") >= EVIDENCE)).withColumn("w", odds).filter("w >= 2").orderBy(F.desc(F.col("w") * F.sqrt("a")), "term").limit(most)
        out.append({s: 6.0 for s in SEEDS} | {r["term"]: min(float(r["w"]), 8.0) for r in best.collect()})
    return out


def knots(boundaries: list[float], heights: list[float]) -> tuple[list[float], list[float]]:
    """The middles of an isotonic fit's steps and their heights, ends included, both rising."""
    steps: list[list[float]] = []
    for x, y in zip(boundaries, heights, strict=True):
        if steps and steps[-1][2] == y:
            steps[-1][1] = x
        else:
            steps.append([x, x, y])
    at = [(-1e-9, 0.0), *(((a + b) / 2, y) for a, b, y in steps), (1 + 1e-9, 1.0)]
    return [x for x, _ in at], [y for _, y in at]


@dataclass
class Model:
    """What a fit leaves: the lexicons, the trees and the knots of the calibration, or a constant."""

    lexicons: Broadcast | None = None
    trees: GBTClassificationModel | None = None
    calibration: tuple[list[float], list[float]] | None = None
    constant: float = 0.0

    def score(self, docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """keys (the text may be one) and score (0 to 1) of every row."""
        rows = need(docs, *dict.fromkeys((*keys, text)))
        if self.trees is None:
            return rows.select(*keys, F.lit(self.constant).alias("score"))
        x = rows.select(*keys, array_to_vector(_features(self.lexicons)(text, F.lit(BOTH))).alias("features"))
        raw = _margin(self.trees, x, *keys)
        xs, ys = (F.array(*map(F.lit, v)) for v in self.calibration)
        below = raw.withColumn("_k", F.size(F.filter(xs, lambda v: v <= F.col("raw"))))
        a, b, u, v = F.get(xs, F.col("_k") - 1), F.get(xs, F.col("_k")), F.get(ys, F.col("_k") - 1), F.get(ys, F.col("_k"))
        return below.select(*keys, (u + (v - u) * (F.col("raw") - a) / (b - a)).alias("score"))


def _margin(trees: GBTClassificationModel, vectors: DataFrame, *keep: str) -> DataFrame:
    """The trees' probability of label 1."""
    return trees.transform(vectors).select(*keep, vector_to_array("probability")[1].alias("raw"))


#: The lexicon of both halves among those that are mined.
BOTH = 2


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = SAMPLE, seed: int = 5) -> Model:
    """Fit on at most `most` labelled rows. The caller leaves out of `labels` what must stay unseen."""
    spark = docs.sparkSession
    known = need(labels, key, label).dropna().groupBy(key).agg(F.max(F.col(label).cast("int")).alias(label))
    # At most `most` small rows, so the join's small side has a proven bound.
    chosen = known.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most)
    sample = need(docs, key, text).join(F.broadcast(chosen), key).groupBy(key, label).agg(F.min(text).alias(text))
    dealt = F.xxhash64(key, F.lit(seed + 1))
    with scratch_run(spark, "toxicity"):
        sample = materialize(sample.withColumns({"apart": F.pmod(dealt, F.lit(4)) == 0, "half": F.pmod(F.shiftright(dealt, 8), F.lit(2)).cast("int")}), "toxicity-sample")
        seen = sample.agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.sum(F.when(~F.col("apart"), F.col(label))).alias("learnt"), F.count_if(~F.col("apart")).alias("learning")).first()
        n, pos, learnt = (int(seen[c] or 0) for c in ("n", "pos", "learnt"))
        if not 0 < pos < n or not 0 < learnt < int(seen["learning"]):
            return Model(constant=pos / n if n else 0.0)
        lexicons = spark.sparkContext.broadcast(mine_lexicons(sample.filter(~F.col("apart")), text, label))
        which = F.when(F.col("apart"), F.lit(BOTH)).otherwise(1 - F.col("half"))
        made = materialize(sample.select(label, "apart", _features(lexicons)(text, which).alias("x")), "toxicity-features").coalesce(2)
        vectors = made.select(label, "apart", array_to_vector("x").alias("features"))
        trees = GBTClassifier(labelCol=label, featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxMemoryInMB=64, cacheNodeIds=False).fit(vectors.filter(~F.col("apart")))
        apart = _margin(trees, vectors.filter("apart"), label).withColumn(label, F.col(label).cast("double"))
        if 0 < pos - learnt < n - int(seen["learning"]):
            fitted = IsotonicRegression(labelCol=label, featuresCol="raw").fit(apart)
            calibration = knots(fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist())
        else:
            calibration = [-1e-9, 1 + 1e-9], [pos / n, pos / n]
    return Model(lexicons, trees, calibration)


def crc_fold(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds

