"""Operator 8, token ids as canonical length-limited Huffman codes.

Code lengths come from the counts of all ids, by package-merge under a limit of
``LIMIT`` bits; canonical codes follow from the lengths alone. A document's ids
are cut into blocks that decode independently; a block has the bit offset of
every ``EVERY``-th id, so that decoding may start there.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrow import HashCache, PolyHash, codepoints, concatenated, map_text, mix64, strings, text_chunks
from palimpsest.storage import stash

LIMIT, BLOCK, EVERY = 24, 4096, 512
#: Bits of the decoder's table; longer codes are searched.
TABLE = 16
SECOND_BASE = 0xD1342543DE82EF95
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = np.zeros(0x3001, bool)
BLANKS[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_encoders: dict[tuple[str, str], Tokenizer] = {}


class Tokenizer:
    """Byte-level BPE from a file of ranks, with the ids of segments it met, by two 64-bit hashes.
    Where one of them agrees and the other doesn't, texts are encoded without what is remembered.

    The pattern never takes a blank together with the sign before it, so a text may be cut
    where a space or newline follows something else, and its ids are those of the parts.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = HashCache(np.dtype([("at", np.int64), ("n", np.int64), ("check", np.uint64)]))
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each."""
        points, offsets = codepoints(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank = BLANKS[np.minimum(points, len(BLANKS) - 2)]  # the last but one isn't a blank
        blank |= points == 0x3000
        cut = np.r_[True, ((points[1:] == 32) | (points[1:] == 10)) & ~blank[:-1]]
        cut[offsets[:-1][offsets[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(points)]
        hashes = mix64(PolyHash(points)(starts, ends) + (ends - starts).astype(np.uint64))
        check = mix64(PolyHash(points, SECOND_BASE)(starts, ends))
        keys, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self.cache.find(keys)
        check, all_check = check[first], check
        if (all_check != check[each]).any() or (known.any() and (self.cache.values["check"][at[known]] != check[known]).any()):
            made = [np.array(self.encode(x), np.int32) for x in texts.to_pylist()]
            return np.concatenate(made), np.array([len(m) for m in made], np.int64)
        if not known.all():
            if len(self.cache.keys) + len(keys) > self.cache.limit:
                self.cache.clear()
                self.used, known = 0, np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            self._learn(keys[new], check[new], points, starts[first[new]], ends[first[new]])
            at, _ = self.cache.find(keys)
        got = self.cache.values[at][each]
        total = int(got["n"].sum())
        jump = np.repeat(got["at"] - np.r_[0, np.cumsum(got["n"])[:-1]], got["n"])
        row = np.searchsorted(offsets, starts, "right") - 1
        return self.ids[jump + np.arange(total)], np.bincount(row, weights=got["n"], minlength=len(texts)).astype(np.int64)

    def _learn(self, keys: np.ndarray, check: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        made = [self.encode(points[a:b].tobytes().decode("utf-32-le")) for a, b in zip(starts.tolist(), ends.tolist())]
        sizes = np.array([len(m) for m in made], np.int64)
        flat = np.fromiter((i for m in made for i in m), np.int32, int(sizes.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.cache.add(keys, np.array(list(zip(self.used + np.cumsum(sizes) - sizes, sizes, check)), self.cache.kind))
        self.used += len(flat)


def tokenizer(path: str, pattern: str = PATTERN) -> Tokenizer:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Tokenizer(path, pattern)
    return _encoders[path, pattern]


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge)."""
    ids = sorted((i for i, n in counts.items() if n > 0), key=lambda i: (counts[i], i))
    if len(ids) < 2:
        return dict.fromkeys(ids, 1)
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit {limit} bits")
    n, leaves = len(ids), np.array([counts[i] for i in ids], np.float64)
    # A row's list merges the leaves with pairs of the row below; the number of
    # leaves among its first ones says how many lengths grow by a bit.
    merged, ranks = [leaves], [np.ones(n, bool)]
    for _ in range(limit - 1):
        below = merged[-1]
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        merged.append(both[order])
        ranks.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(ranks):
        got = int(is_leaf[:take].sum())
        lengths[:got] += 1
        take = 2 * (take - got)
    return dict(zip(ids, lengths.tolist()))


class Codebook:
    """Canonical codes: shorter ones first, by id among equals."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.symbols = np.array(order, np.int64)
        self.lengths = np.array([lengths[i] for i in order], np.int64)
        self.longest = int(self.lengths.max()) if len(order) else 0
        # left-aligned codes are running sums of the shares of the code space
        share = np.left_shift(1, self.longest - self.lengths) if len(order) else np.zeros(0, np.int64)
        self.firsts = np.cumsum(share) - share
        size = int(self.symbols.max()) + 1 if len(order) else 0
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.symbols] = self.firsts >> (self.longest - self.lengths)
        self.bits[self.symbols] = self.lengths

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first byte of each block and the end, bit offset of each id
        in its block); blocks are ``ids[bounds[i]:bounds[i + 1]]``, each from a full byte."""
        bits = self.bits[ids]
        total = np.r_[0, np.cumsum(bits)]
        sizes = (np.diff(total[bounds]) + 7) // 8
        starts = np.r_[0, np.cumsum(sizes)]
        block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        offset = total[:-1] - total[bounds[block]]
        at = offset + 8 * starts[block]
        out = np.zeros(int(starts[-1]) // 4 + 3, np.uint32)
        if len(ids):
            # a code of up to 32 bits lies in one word of 64 bits that starts at a multiple of 32
            word = at >> 5
            placed = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            whole = np.add.reduceat(placed, heads)
            out[word[heads]] |= (whole >> np.uint64(32)).astype(np.uint32)
            out[word[heads] + 1] |= whole.astype(np.uint32)
        return out.astype(">u4").view(np.uint8)[: int(starts[-1])], starts, offset

    def table(self) -> tuple[np.ndarray, int]:
        """The place in canonical order of the code that each value of the next bits starts with,
        or -1 if that code is longer; and the number of these bits."""
        if not hasattr(self, "_table"):
            bits = min(TABLE, self.longest)
            place = np.searchsorted(self.firsts, np.arange(1 << bits) << (self.longest - bits), "right") - 1
            self._table = np.where(self.lengths[place] <= bits, place, -1) if len(self.symbols) else place, bits
        return self._table

    def decode_many(self, data: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other: ``counts[i]`` of them from bit
        ``bits[i]`` of ``data`` on. All pieces go forward together, an id at a time, by table."""
        table, width = self.table()
        padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
        words = np.zeros(len(data) + 1, np.uint64)  # five bytes from each byte on
        for i in range(5):
            words |= padded[i : i + len(words)] << np.uint64(32 - 8 * i)
        order = np.argsort(-counts, kind="stable")
        left, at = counts[order], bits[order].astype(np.int64)
        starts = (np.cumsum(counts) - counts)[order]
        out = np.zeros(int(counts.sum()), np.int64)
        live = len(order)
        for i in range(int(left[0]) if live else 0):
            live = int(np.searchsorted(-left[:live], -i, "left"))
            here = at[:live]
            code = (words[here >> 3] << (here & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
            place = table[(code >> np.uint64(40 - width)).astype(np.int64)]
            long = np.flatnonzero(place < 0)
            if len(long):
                place[long] = np.searchsorted(self.firsts, (code[long] >> np.uint64(40 - self.longest)).astype(np.int64), "right") - 1
            out[starts[:live] + i] = self.symbols[place]
            here += self.lengths[place]
        return out

    def decode(self, payload: bytes, n: int, bit: int = 0) -> np.ndarray:
        """``n`` ids from the bit offset on."""
        return self.decode_many(np.frombuffer(payload, np.uint8), np.array([bit]), np.array([n]))

    def to_bytes(self) -> bytes:
        """Pairs of id and length, in canonical order."""
        return b"".join(struct.pack("<IB", int(s), int(n)) for s, n in zip(self.symbols, self.lengths))

    @classmethod
    def from_bytes(cls, data: bytes) -> Codebook:
        return cls(dict(struct.iter_unpack("<IB", data)))


def id_width(path: str) -> int:
    """Bytes of an id: two if all of the vocabulary's fit, else four."""
    with open(path, "rb") as f:
        return 2 if max(int(line.split()[1]) for line in f if line.strip()) < 1 << 16 else 4


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows of a binary column, one after the other."""
    return np.frombuffer(concatenated(column), f"<u{width}").astype(np.int64)


def token_ids(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) of every row, ids little-endian of ``id_width`` bytes;
    null and empty texts have no ids."""
    kind, width = docs.select(id_col).schema[0].dataType.simpleString(), id_width(path)

    def run(chunk: pa.RecordBatch):
        ids, sizes = tokenizer(path, pattern).ids_of(strings(chunk.column(1)))
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * width
        made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
        yield pa.RecordBatch.from_arrays([chunk.column(0), made], ["doc_id", "ids"])

    return map_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, ids binary", limit=1 << 20)


def count_ids(ids: DataFrame, width: int) -> dict[int, int]:
    """How often each id occurs in all rows. Each task adds up its own first."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in text_chunks(batches, 0):
            part = np.bincount(_flat(b.column(0), width), minlength=len(total))
            part[: len(total)] += total
            total = part
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("id").to_pylist(), rows.column("n").to_pylist()))


def encode_blocks(ids: DataFrame, book: Codebook, width: int, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """(doc_id, block, n_ids, n_bits, payload, checkpoints, every) from (doc_id, ids);
    ``checkpoints`` are the bit offsets of each ``every``-th id.

    A row without ids has one block of none, so that it comes back; null ids count as none.
    """
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in text_chunks(batches, 1, 1 << 20):
            yield _encoded(b, book, width, block, every)

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, block int, n_ids int, n_bits bigint, payload binary, checkpoints array<int>, every int")


def _encoded(b: pa.RecordBatch, book: Codebook, width: int, block: int, every: int) -> pa.RecordBatch:
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // width
    flat = _flat(b.column(1), width)
    blocks = np.maximum(1, -(-sizes // block))
    row = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n = np.minimum(sizes[row] - number * block, block)
    bounds = np.r_[0, np.cumsum(n)]
    data, starts, offset = book.encode(flat, bounds)
    payload = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    inner = np.arange(len(flat)) - np.repeat(bounds[:-1], n)
    marks = np.flatnonzero(inner % every == 0)
    points = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(-(-n // every))].astype(np.int32)), pa.array(offset[marks].astype(np.int32)))
    bits = np.zeros(len(row), np.int64)
    full = n > 0
    bits[full] = offset[bounds[1:][full] - 1] + book.bits[flat[bounds[1:][full] - 1]]
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bits), payload, points, pa.array(np.full(len(row), every, np.int32))], ["doc_id", "block", "n_ids", "n_bits", "payload", "checkpoints", "every"])


def compress(docs: DataFrame, path: str, pattern: str = PATTERN, limit: int = LIMIT, block: int = BLOCK, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of every row of ``docs``, as ``encode_blocks`` says, and one more
    row with block -1 and a null doc_id whose payload is the codebook.

    Every text is coded whole, whatever its length; a null or empty one has one
    empty block. Repeated rows repeat their blocks. Other columns aren't read. An
    empty table gives an empty codebook.
    """
    ids = stash(token_ids(docs, path, pattern, id_col, text_col), "ids")
    width = id_width(path)
    book = Codebook(code_lengths(count_ids(ids, width), limit))
    blocks = encode_blocks(ids, book, width, block, every)
    head = docs.sparkSession.createDataFrame([(None, -1, len(book.symbols), 0, bytearray(book.to_bytes()), [], every)], blocks.schema)
    return blocks.unionByName(head)


def decompress(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, ids) of all blocks of ``compress``'s rows but the codebook's. The pieces
    between checkpoints are decoded side by side."""
    book = Codebook.from_bytes(bytes(blocks.filter("block = -1").first().payload))
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in text_chunks(batches, 3, 1 << 20):
            payload, marks = b.column(3), b.column(4)
            n = b.column(2).to_numpy().astype(np.int64)
            sizes = pc.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64)
            pieces = pc.list_value_length(marks).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            step = b.column(5).to_numpy().astype(np.int64)
            counts = np.minimum(step[row], n[row] - number * step[row])
            bits = marks.flatten().to_numpy(zero_copy_only=False) + 8 * (np.cumsum(sizes) - sizes)[row]
            ids = book.decode_many(np.frombuffer(concatenated(payload), np.uint8), bits, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "block", "ids"])

    return blocks.filter("block >= 0").select("doc_id", "block", "n_ids", "payload", "checkpoints", "every").mapInArrow(run, f"doc_id {kind}, block int, ids array<int>")
