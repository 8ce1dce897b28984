"""Arrow helpers shared by the operators: bounded chunks and array kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 2 << 20
HASH_BASE = 0x9E3779B97F4A7C15


def text_chunks(batches, text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each; a row
    that is longer comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``fn`` over chunks of ``df``, whose second column is the text."""

    def run(batches):
        for chunk in text_chunks(batches, 1, limit):
            yield from fn(chunk)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task without it

    return df.mapInArrow(run, schema)


def strings(column) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array without nulls, and row offsets."""
    points = np.frombuffer(concatenated(column).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return points, offsets


def concatenated(column: pa.Array) -> bytes:
    """The UTF-8 bytes of all rows, one after the other."""
    if not len(column) or column.buffers()[2] is None:
        return b""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + column.offset + 1)[column.offset :]
    return memoryview(column.buffers()[2])[int(ends[0]) : int(ends[-1])].tobytes()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class PolyHash:
    """Polynomial hashes (Horner, modulo 2**64) of any slices of one array."""

    def __init__(self, values: np.ndarray, base: int = HASH_BASE):
        n = len(values)
        self.up = powers(base, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * powers(pow(base, -1, 1 << 64), n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # sum of v[j] * B**(end-1-j) over start <= j < end
        return (self.sums[ends] - self.sums[starts]) * self.up[np.maximum(ends - 1, 0)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: the row of each, the words, their code
    points with offsets, and a 64-bit hash of each."""
    lists = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    points, offsets = codepoints(words)
    full = np.flatnonzero(np.diff(offsets))  # leading white space gives empty ones
    if len(full) < len(words):
        words, row = words.take(pa.array(full)), row[full]
        offsets = np.r_[offsets[full], offsets[-1]] if len(full) else np.zeros(1, np.int64)
    return row, words, points, offsets, mix64(PolyHash(points)(offsets[:-1], offsets[1:]))


class HashCache:
    """Values by 64-bit key for one worker, emptied when it holds ``limit`` keys."""

    def __init__(self, kind, limit: int = 400_000):
        self.kind, self.limit = kind, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, self.kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't there yet, each once."""
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.values, values])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
