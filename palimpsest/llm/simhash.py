"""Operator 5, near-duplicates by SimHash and covering locality-sensitive hashing.

A document has three independent 64-bit SimHashes over its set of normalised
words, and two documents are near-duplicates if one of the three pairs of
signatures differs in at most 6 bits: one signature alone leaves many near
copies just outside its radius, by chance. The
masks of the tables come from the linear code RM(1, 6): bit i of a signature
carries the vector (1, binary digits of i), and for every non-zero v of seven
bits the mask of table v keeps the bits whose vector has odd product with v.
Any six differing bits span at most six of the seven dimensions, so some v is
orthogonal to all of them and both signatures agree under its mask: no pair
within radius 6 is missed. 126 of the 127 masks keep exactly 32 bits; the one
that keeps all 64 only finds equal signatures, which are one signature here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.arrow import HASH_BASE, PolyHash, codepoints, map_text, mix64, strings
from palimpsest.llm.components import connected_components
from palimpsest.storage import small_side, stash

BITS, RADIUS, SIGNATURES = 64, 6, 3
NAMES = [f"s{k}" for k in range(SIGNATURES)]
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Signatures that a task sorts at a time, those of a range of keys on average, and ranges at most,
#: so that a block holds a few hundred signatures or more.
FLUSH, RANGE, MOST_RANGES = 1 << 20, 1 << 17, 1 << 12


def covering_masks() -> list[int]:
    """The 126 masks as signed 64-bit integers."""
    out = []
    for v in range(1, 1 << (RADIUS + 1)):
        mask = sum(1 << i for i in range(BITS) if bin(((1 << 6) | i) & v).count("1") & 1)
        if mask.bit_count() < BITS:
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The SimHashes of each text as columns, and whether it has a word at all."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), NOT_WORD, "").dictionary_encode()
    word = plain.indices.to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)]
    points, offsets = codepoints(plain.dictionary)
    blank = np.diff(offsets) == 0
    hashes = mix64(PolyHash(points)(offsets[:-1], offsets[1:]))
    pairs = np.unique(row.astype(np.int64) * max(len(blank), 1) + word) if len(row) else np.zeros(0, np.int64)
    row, word = np.divmod(pairs, max(len(blank), 1))
    row, word = row[~blank[word]], word[~blank[word]]
    has = np.zeros(n, bool)
    has[row] = True
    out = np.zeros((n, SIGNATURES), np.int64)
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(row)]
    for k in range(SIGNATURES):
        salted = hashes if k == 0 else mix64(hashes + np.uint64(k * HASH_BASE % (1 << 64)))
        signs = np.unpackbits(salted.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
        a = 0
        while a < len(heads):  # some 100,000 words at a time
            b = max(a + 1, int(np.searchsorted(ends, heads[a] + 100_000, "right")))
            sums = np.add.reduceat(signs[word[heads[a] : ends[b - 1]]], heads[a:b] - heads[a], axis=0, dtype=np.int32)
            out[row[heads[a:b]], k] = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64).reshape(-1)
            a = b
    return out, has


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s0, s1, s2) of each document that has a letter or digit."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(chunk: pa.RecordBatch):
        sig, has = signatures_of(strings(chunk.column(1)))
        keep = pa.array(has)
        yield pa.RecordBatch.from_arrays([chunk.column(0).filter(keep), *[pa.array(sig[:, k]).filter(keep) for k in range(SIGNATURES)]], ["doc_id", *NAMES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return map_text(rows, run, f"doc_id {kind}, {', '.join(f'{s} bigint' for s in NAMES)}")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as bitwise_count takes absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def bucket_edges(sigs: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs within ``radius`` connect, among distinct
    signatures of one bucket. Each one is compared with all that aren't yet
    reached, so that a tight group of m costs m comparisons and m - 1 edges."""
    edges, rest = [], sigs
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = hamming(rest, x) <= radius
            if near.any():
                reached += list(rest[near])
                edges += [(x, y) for y in rest[near]]
                rest = rest[~near]
    return edges


class Turns:
    """The signatures' bits in the order of each table: those that its mask keeps
    come first, so that equal keys lie together and sorted signatures have small
    differences. Bits move by a look-up of each byte; Hamming distances stay."""

    def __init__(self) -> None:
        self.there, self.back = [], []
        for mask in covering_masks():
            kept = [i for i in range(BITS) if mask >> i & 1]
            rest = [i for i in range(BITS) if not mask >> i & 1]
            place = {bit: BITS - 1 - n for n, bit in enumerate(kept + rest)}
            self.there.append(self._tables(place))
            self.back.append(self._tables({v: k for k, v in place.items()}))

    @staticmethod
    def _tables(place: dict[int, int]) -> np.ndarray:
        out = np.zeros((8, 256), np.uint64)
        byte = np.arange(256)
        for bit, to in place.items():
            out[bit // 8] |= (byte >> bit % 8 & 1).astype(np.uint64) << np.uint64(to)
        return out

    @staticmethod
    def move(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
        out = tables[0][parts[:, 0]]
        for i in range(1, 8):
            out |= tables[i][parts[:, i]]
        return out


_turns: list[Turns] = []


def turns() -> Turns:
    if not _turns:
        _turns.append(Turns())
    return _turns[0]


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers: the first one, and the differences in as few bytes each as the largest needs."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(block: bytes) -> np.ndarray:
    width, rest = block[0], np.frombuffer(block, np.uint8, offset=9)
    steps = np.zeros((len(rest) // width, 8), np.uint8)
    steps[:, :width] = rest.reshape(-1, width)
    return np.cumsum(np.r_[np.frombuffer(block, np.uint64, 1, 1), steps.view(np.uint64).reshape(-1)], dtype=np.uint64)


def _blocks(bits: int):
    """From (k, sig): a block for each table of each signature and each range of keys, the leading ``bits``."""

    def emit(k, sig):
        for which in range(SIGNATURES):
            own = sig[k == which].view(np.uint64)
            if not len(own):
                continue
            for t, tables in enumerate(turns().there):
                moved = np.sort(Turns.move(tables, own))
                part = (moved >> np.uint64(BITS - bits)).astype(np.int32) if bits else np.zeros(len(moved), np.int32)
                heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                made = [packed(moved[a:b]) for a, b in zip(heads, [*heads[1:], len(moved)])]
                n = len(made)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, which, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(part[heads]), pa.array(made, pa.binary())], ["k", "t", "r", "block"])

    def run(batches):
        held, n = [], 0
        for batch in (*batches, None):
            if batch is not None:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n and (batch is None or n >= FLUSH):
                yield from emit(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0

    return run


def _found(radius: int):
    """The edges within one range of one table."""

    def run(table: pa.Table) -> pa.Table:
        which, t = table.column("k")[0].as_py(), table.column("t")[0].as_py()
        blocks = [unpacked(x.as_buffer().to_pybytes()) for chunk in table.column("block").chunks for x in chunk]
        sig = np.sort(np.concatenate(blocks)) if len(blocks) > 1 else blocks[0]
        key = sig >> np.uint64(BITS // 2)
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(key)])
        two = heads[sizes == 2]
        near = two[hamming(sig[two], sig[two + 1]) <= radius]
        a, b = [sig[near]], [sig[near + 1]]
        for h, m in zip(heads[sizes > 2], sizes[sizes > 2]):
            if edges := bucket_edges(sig[h : h + m], radius):
                x, y = np.array(edges, np.uint64).T
                a.append(x)
                b.append(y)
        back = turns().back[t]
        a, b = (Turns.move(back, np.concatenate(x)).view(np.int64) for x in (a, b))
        return pa.table({"k": np.full(len(a), which, np.int64), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def signature_edges(sigs: DataFrame, radius: int = RADIUS, ranges: int | None = None) -> DataFrame:
    """(a, b): edges between first signatures whose components are those of all
    pairs of (s0, s1, s2) that have a signature within ``radius`` (at most 6).

    What is shuffled are sorted blocks of signatures, in the bit order of their table and some seven bytes
    each, by table and range of keys. Only the few pairs that are found in the other
    signatures are then joined with the first ones. ``ranges``: a power of two, by default as the
    number of signatures wants; it only says how the work is cut.
    """
    if radius > RADIUS:
        raise ValueError(f"these masks cover a radius of {RADIUS}")
    ranges = ranges or min(MOST_RANGES, 1 << max(0, -(-sigs.count() // RANGE) - 1).bit_length())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).alias("sig")) for k, s in enumerate(NAMES)])).alias("e")
    one = sigs.select(each).select("e.k", "e.sig").distinct()
    blocks = one.mapInArrow(_blocks(ranges.bit_length() - 1), "k int, t int, r int, block binary")
    pairs = stash(blocks.groupBy("k", "t", "r").applyInArrow(_found(radius), "k bigint, a bigint, b bigint").distinct(), "pairs")
    # the other signatures by their documents' first ones; where there are several, these are edges too
    owned = sigs.select("s0", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(s).alias("sig")) for k, s in enumerate(NAMES) if k])).alias("e")).select("s0", "e.k", "e.sig")
    owner = stash(owned.groupBy("k", "sig").agg(F.min("s0").alias("first"), F.max("s0").alias("last")), "owners")
    of = lambda x: small_side(owner).select("k", F.col("sig").alias(x), F.col("first").alias(f"{x}0"))
    other = pairs.filter("k > 0").join(of("a"), ["k", "a"]).join(of("b"), ["k", "b"]).select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    shared = owner.filter("first <> last").drop("last")
    linked = owned.join(shared, ["k", "sig"]).select(F.col("first").alias("a"), F.col("s0").alias("b"))
    return pairs.filter("k = 0").select("a", "b").unionByName(other).unionByName(linked).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, doc_id, keep_id, sig, copies, links): the rows of ``near_duplicate_groups``
    with their first signature; ``label`` identifies their group."""
    found = stash(signatures(docs, id_col, text_col), "signatures")
    edges = stash(signature_edges(stash(found.select(*NAMES).distinct(), "distinct"), radius), "edges")
    labels = connected_components(edges)
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    labels = stash(labels.join(links, "node"), "components")
    group = F.coalesce("label", "sig")
    sigs = found.groupBy("doc_id", F.col("s0").alias("sig")).agg(F.count("*").alias("copies"))
    members = sigs.join(small_side(labels).withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", group)
    whole = members.groupBy("label").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("n")).filter("n > 1")
    return members.join(whole, "label").select("label", "doc_id", "keep_id", "sig", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, keep_id, copies, links): the members of all groups of two documents or more.

    Groups are the components of the pairs of which one of the signatures differs in
    at most ``radius`` bits; ``group_id`` is the smallest first signature in the group, ``keep_id`` the
    smallest id, null only if all are; ``copies`` counts the group's rows with this id and signature,
    ``links`` the other signatures that this one was found near to while the group was put
    together: at least one where the group has several, and enough to connect them.
    Null, empty and wordless texts have no signature and are in no group; long
    texts are hashed whole. Repeated rows are one output row with ``copies``
    above one. Other columns aren't read.
    """
    return labelled_groups(docs, radius, id_col, text_col).select("doc_id", F.col("label").alias("group_id"), "keep_id", "copies", "links")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group.

    The one with the smallest id stays, of equal ids the one with the smallest
    signature, of equal rows one. Documents without a signature stay. Only the
    ids to drop meet the texts, in an anti-join.
    """
    groups = stash(labelled_groups(docs, radius, id_col, text_col), "groups")
    first = groups.filter("doc_id <=> keep_id").groupBy("label").agg(F.min("sig").alias("keep_sig"))
    kept_row = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sig") == F.col("keep_sig"))
    judged = stash(groups.join(first, "label").select("doc_id", "sig", "copies", kept_row.alias("keep")), "judged")
    # An id whose rows don't share one fate is settled row by row below.
    split = judged.groupBy("doc_id").agg(F.max(F.col("keep").cast("int")).alias("any"), F.sum("copies").alias("n"))
    repeated = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("rows")).filter("rows > 1")
    odd = stash(split.join(repeated, split.doc_id.eqNullSafe(repeated.doc_id), "left_semi").select("doc_id"), "odd")
    gone = stash(split.filter("any = 0").select("doc_id").unionByName(odd).distinct(), "gone")
    same = lambda side: docs[id_col].eqNullSafe(side["doc_id"])
    side = small_side(gone)
    out = docs.join(side, same(side), "left_anti")
    if odd.isEmpty():
        return out
    side = small_side(odd)
    rows = docs.join(side, same(side), "left_semi")
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), rows[id_col].alias("doc_id"), rows[text_col].alias("text"))
    hashed = _with_signature(packed)
    fate = judged.select(F.col("doc_id").alias("j_id"), F.col("sig").alias("j_sig"), "keep")
    joined = hashed.join(fate, hashed.doc_id.eqNullSafe(fate.j_id) & (hashed.sig == fate.j_sig), "left")
    order = Window.partitionBy("doc_id", "sig").orderBy("text")
    settled = joined.withColumn("n", F.row_number().over(order)).filter("keep IS NULL OR (keep AND n = 1)")
    return out.unionByName(settled.select("row.*"))


def _with_signature(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("bigint")
    def sig(texts):
        values, has = signatures_of(strings(pa.Array.from_pandas(texts, type=pa.string())))
        import pandas as pd

        return pd.Series(values[:, 0]).astype("Int64").where(pd.Series(has))

    return rows.withColumn("sig", sig("text"))
