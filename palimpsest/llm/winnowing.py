"""Operator 2, document fingerprints by winnowing.

Every ``k`` consecutive characters get a rolling hash; of every ``window``
consecutive hashes the smallest is chosen, the rightmost one on ties, and kept
with its position. Two texts that share ``window + k - 1`` consecutive
characters therefore share a fingerprint, at positions inside that passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrow import HASH_BASE, PolyHash, codepoints, map_text, strings

MASK = np.uint64((1 << 63) - 1)


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Index of the rightmost minimum of each full window of ``values``."""
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at


def select(points: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in row, hash) of all chosen k-grams of the rows."""
    empty = np.zeros(0, np.int64)
    if len(points) < k:
        return empty, empty, empty
    starts = np.arange(len(points) - k + 1)
    hashes = (PolyHash(points)(starts, starts + k) & MASK).astype(np.int64)
    grams = np.diff(offsets) - k + 1
    picks = [empty]
    if len(hashes) >= window:
        at = sliding_min(hashes, window)
        row = np.repeat(np.arange(len(grams)), np.diff(offsets))[: len(at)]
        full = np.arange(len(at)) - offsets[row] + window <= grams[row]
        at = at[full]
        picks.append(at[np.r_[True, at[1:] != at[:-1]]].astype(np.int64) if len(at) else empty)
    for row in np.flatnonzero((grams > 0) & (grams < window)):  # one short window
        a = offsets[row]
        part = hashes[a : a + grams[row]]
        picks.append(np.array([a + len(part) - 1 - int(np.argmin(part[::-1]))], np.int64))
    at = np.sort(np.concatenate(picks))
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], hashes[at]


def fingerprints(docs: DataFrame, k: int = 32, window: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, hash): the chosen k-grams, positions counted in characters from 0.

    Text is taken as it is, whole, whatever its length. A text shorter than
    ``k`` characters, empty or null has no k-gram and gives no row; one with
    fewer than ``window`` k-grams is one window. Rows are treated one by one:
    repeated rows repeat their fingerprints, a null id stays null. Other
    columns, whatever their names, aren't read.
    """
    if k < 1 or window < 1:
        raise ValueError("k and window must be positive")
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()

    def run(chunk: pa.RecordBatch):
        points, offsets = codepoints(strings(chunk.column(1)))
        row, pos, hashes = select(points, offsets, k, window)
        yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(row)), pa.array(pos), pa.array(hashes)], ["doc_id", "pos", "hash"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(rows.filter(F.length("text") >= k), run, f"doc_id {kind}, pos bigint, hash bigint", limit=2 << 20)
