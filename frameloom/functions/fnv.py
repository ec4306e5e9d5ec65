"""Sampled FNV-1a fingerprints of file contents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: FNV-1a 32-bit offset basis and prime, samples of the body, bytes of the tail (fixed values).
BASIS, PRIME, SAMPLES, TAIL, MASK = 2166136261, 16777619, 4096, 64, 0xFFFFFFFF


def sampled(content: bytes) -> np.ndarray:
    """Every (length div SAMPLES)-th byte, then the last TAIL bytes again."""
    raw = np.frombuffer(content, np.uint8)
    return np.concatenate([raw[:: max(1, len(raw) // SAMPLES)], raw[max(0, len(raw) - TAIL) :]])


def fold(rows: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of many sample rows: one step for each column, all rows at once, longest rows first."""
    lens = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-lens, kind="stable")
    acc = np.full(len(rows), BASIS, np.uint64)
    if len(rows) == 0 or lens.max() == 0:
        return acc
    table = np.zeros((len(rows), int(lens.max())), np.uint8)
    for k, i in enumerate(order):
        table[k, : lens[i]] = rows[i]
    live = np.searchsorted(-lens[order], -np.arange(table.shape[1]), side="left")
    run = acc.copy()
    for j in range(table.shape[1]):
        n = live[j]
        run[:n] = ((run[:n] ^ table[:n, j]) * np.uint64(PRIME)) & np.uint64(MASK)
    acc[order] = run
    return acc


@F.pandas_udf(StringType())
def sampled_fingerprint(content: pd.Series) -> pd.Series:
    """`length:hex` of each content, null for null."""
    out: list[str | None] = [None] * len(content)
    full = [i for i, c in enumerate(content) if c is not None]
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        for i, h in zip(some, fold([sampled(content.iloc[i]) for i in some]).tolist(), strict=True):
            out[i] = f"{len(content.iloc[i])}:{h:x}"
    return pd.Series(out, dtype="object")
