"""Whitening of embeddings from an exact scatter matrix, kept as residues.

Entries become whole numbers, x = floor(256 c). The fit list holds each distinct vector once. Its size n and the sums
S of its dimensions are exact, so n x - S is the centred vector as whole numbers, and the scatter of these is wanted
without rounding. It is computed modulo several primes of twenty bits: a task multiplies blocks of BLOCK residue vectors
in doubles, which hold such sums exactly, and keeps one matrix of residues for each prime. Spark adds the residues of all
tasks, the driver joins them by Chinese remaindering to the exact scatter, and divides once by n^3. As many primes are
taken as the measured size of n, x and S asks for. eigh in doubles gives the components.

The driver holds d x d numbers for each prime, d the dimensions of a vector, whatever the number of rows. The distinct
vectors are written once (map-side combining first, so a vector that fills a third of the table is no hot key) and
read by three passes. The identity error is measured on the whitened fit list itself.

Defined cases: null vectors and those with null or non-finite entries are dropped, and so are vectors whose length is not the
commonest among distinct ones (the longest of equally common); entries beyond 2^63 / 256 count as the largest whole number; a
null key is kept; repeated rows are kept and weigh once in the fit; a component without spread (a table of one distinct
vector, dimensions that depend on others) has null whitened values and is left out of the identity error; without spread
at all explained and identity error are null; a deviation of 2^63 or more is null; an empty table gives an empty
result; extra columns are ignored; keys named as results are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.common import materialize, need, scratch_run

SCALE = 256
#: Vectors multiplied at once: 2^13 products of two residues of 20 bits stay within the 2^53 of a double.
BLOCK, PRIME_BITS = 1 << 13, 20
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def primes_for(bound: int) -> list[int]:
    """The largest primes of PRIME_BITS bits whose product exceeds the bound, at least two."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound or len(out) < 2:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def remainders_to_number(residues: list[int], primes: list[int]) -> int:
    """The number of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, primes, strict=True):
        value += product * ((int(r) - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def whole(df: DataFrame, keys: tuple[str, ...], vector: str) -> DataFrame:
    """keys and x of the rows whose vector is whole."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # Under the filter no entry is null, so that arrays are compared by value.
    return df.filter(v.isNotNull() & sound).select(*keys, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("_x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _row(shape: str, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [c.split()[0] for c in shape.split(", ")])


def _totals(fit: DataFrame, d: int) -> tuple[int, int, int, list[int]]:
    """n, least and greatest entry, and the exact sum of every dimension."""
    shape = "n long, low long, high long, upper array<long>, lower array<long>"

    def run(batches):
        n, low, high, upper, lower = 0, 2**63 - 1, -(2**63), np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, 0, d):
            n, low, high = n + len(x), min(low, int(x.min())), max(high, int(x.max()))
            upper += (x >> 32).sum(axis=0)  # halves of 32 bits: a task's sums stay whole
            lower += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield _row(shape, n, low, high, upper.tolist(), lower.tolist())

    parts = materialize(fit.mapInArrow(run, shape), "totals")  # one row for each task
    n, low, high = parts.agg(F.sum("n"), F.min("low"), F.max("high")).first()
    whole_sum = [F.sum(F.col(f"z.{c}").cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")]
    sums = parts.select(F.posexplode(F.arrays_zip("upper", "lower")).alias("k", "z")).groupBy("k").agg(*whole_sum).orderBy("k").collect()
    return n, low, high, [(int(r["upper"]) << 32) + int(r["lower"]) for r in sums]


def _scatter(fit: DataFrame, d: int, n: int, sums: list[int], most: int) -> list[list[int]]:
    """The exact scatter of n x - S, no entry of which exceeds `most`."""
    primes = primes_for(2 * n * most * most)
    shape = "prime long, row int, residues array<long>"

    def run(batches):
        held = np.zeros((len(primes), d, d), np.int64)
        for _, x in _blocks(batches, 0, d):
            for k, p in enumerate(primes):
                centred = (((x % p) * (n % p) - np.array([s % p for s in sums])) % p).astype(np.float64)
                held[k] = (held[k] + (centred.T @ centred).astype(np.int64)) % p
        for k, p in enumerate(primes):
            if held[k].any():
                yield pa.RecordBatch.from_arrays([pa.array([p] * d), pa.array(range(d), pa.int32()), pa.array(held[k].tolist(), pa.list_(pa.int64()))], ["prime", "row", "residues"])

    entries = fit.mapInArrow(run, shape).select("prime", "row", F.posexplode("residues").alias("col", "r"))
    summed = entries.groupBy("row", "col").pivot("prime", primes).agg(F.sum("r"))
    out = [[0] * d for _ in range(d)]
    for r in summed.collect():
        out[r["row"]][r["col"]] = remainders_to_number([(r[str(p)] or 0) % p for p in primes], primes)
    return out


@dataclass
class Whitening:
    """A fitted whitening: exact n and sums, and the leading components."""

    n: int
    sums: list[int]
    most: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, through the exact n x - S where that fits 64 bits."""
        if self.most < 2**63:
            return (x * self.n - np.array(self.sums, np.int64)) / float(self.n)
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def _live(self) -> np.ndarray:
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(np.float64).eps

    def whitened(self, x: np.ndarray) -> np.ndarray:
        live = self._live()
        scale = np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), np.nan)
        return (self._centred(x) @ self.vectors) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n x - S. Arithmetic modulo 2^64 is exact where the result has 63 bits."""
        sums = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
        with np.errstate(over="ignore"):
            y = x * np.int64(self.n) - sums
            out: list[int | None] = (y * y).sum(axis=1).tolist()
        about = ((x.astype(np.float64) - np.array([s / self.n for s in self.sums])) ** 2).sum(axis=1) * float(self.n) ** 2
        for k in np.flatnonzero(about > 2.0**62):
            true = sum((self.n * v - s) ** 2 for v, s in zip(x[k].tolist(), self.sums, strict=True))
            out[k] = true if true < 2**63 else None
        return out

    def transform(self, df: DataFrame, keys: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
        """keys and RESULTS: a row for every whole vector and component."""
        d, k, n, error = len(self.sums), self.vectors.shape[1], self.n, self.identity_error
        rows = whole(need(df, *keys, vector), keys, vector).filter(F.size("_x") == d)
        explained = [float(e / self.trace) if self.trace > 0 else None for e in self.values]

        def run(batches):
            for part, x in _blocks(batches, len(keys), d):
                m = len(x)
                at = pa.array(np.repeat(np.arange(m), k))
                white = self.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in part.columns[: len(keys)]), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array([n] * (m * k), pa.int64()),
                     pa.array(self.deviation(x), pa.int64()).take(at), pa.array(white, pa.float64(), mask=np.isnan(white)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    [*keys, *RESULTS])

        return rows.mapInArrow(run, _shape(rows, keys))


def _shape(rows: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    return T.StructType([*(rows.schema[c] for c in keys), *(T.StructField(a, b) for a, b in zip(RESULTS, kinds, strict=True))])


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    d, live = len(model.sums), np.flatnonzero(model._live())
    if not len(live):
        return None
    shape = "products array<double>"

    def run(batches):
        held = np.zeros((len(live), len(live)))
        for _, x in _blocks(batches, 0, d):
            w = model.whitened(x)[:, live]
            held += w.T @ w
        yield _row(shape, held.ravel().tolist())

    summed = fit.mapInArrow(run, shape).select(F.posexplode("products").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    cov = np.array([r["v"] for r in summed]).reshape(len(live), -1) / model.n
    return float(np.abs(cov - np.eye(len(live))).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """The whitening of a table of vectors; none if no vector is whole."""
    with scratch_run(df.sparkSession, "whitening"):
        distinct = materialize(whole(need(df, vector), (), vector).distinct(), "vectors")
        lengths = distinct.groupBy(F.size("_x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
        if lengths is None:
            return None
        d = lengths["d"]
        same = distinct.filter(F.size("_x") == d)
        n, low, high, sums = _totals(same, d)
        most = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
        scatter = _scatter(same, d, n, sums, most)
        # Whole numbers divide with one rounding, however large they are.
        covariance = np.array([[v / n**3 for v in row] for row in scatter])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:components]
        model = Whitening(n, sums, most, values[order], vectors[:, order], sum(scatter[i][i] for i in range(d)) / n**3)
        model.identity_error = _identity_error(same, model)
        return model


def whiten(df: DataFrame, keys: tuple[str, ...] = ("vec_id",), vector: str = "embedding", components: int = 4) -> DataFrame:
    """Fit and apply: keys and RESULTS, a row for every whole vector and each of the first components."""
    clash = sorted(set(keys) & set(RESULTS))
    if clash:
        raise ValueError(f"keys named as results: {', '.join(clash)}")
    model = fit(df, vector, components)
    if model is None:
        rows = need(df, *keys)
        return rows.sparkSession.createDataFrame([], _shape(rows, keys))
    return model.transform(df, keys, vector)
