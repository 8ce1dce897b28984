"""Operator 6, packing related documents into windows.

A document is the set of its lower-cased words, a word weighs the square of its
inverse document frequency, and two documents are as alike as the weighted Jaccard
similarity of their sets. Each distinct set gets a sketch: the words race, those
of more weight faster, and the first one in each of ``BINS`` parts of the words
stays; the share of equal bins estimates the similarity. The sketches are sorted in
``ORDERS`` orders, each by other bins first, in which alike sets come to lie near
each other, and a set's neighbours are the most alike of the ``REACH`` before and
after it in each order. No set of documents is compared all with all, and no order
has buckets that a hot group could fill.

Paths come from the undirected graph of these pairs by greedy choice: pairs of
documents of low degree first, then the nearest, each taken if both documents are
still ends of different paths. Windows are filled along the paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.arrow import HASH_BASE, concatenated, map_text, mix64, strings, text_chunks, words_of
from palimpsest.storage import discard, small_side, stash

NEAREST, WINDOW = 5, 2048
#: Bins of a sketch, orders, and places before and after that are compared in each.
BINS, ORDERS, REACH = 128, 8, 32
#: Counters of document frequencies; words that share one count together.
COUNTERS = 1 << 18
#: Rows of a cell of an order on average, cells at most, rows sampled for a cell.
CELL, MOST_CELLS, SAMPLE = 16_384, 1 << 14, 32
#: A path takes no more documents once it would hold more words than this.
PATH_WORDS = 1 << 20
#: Pairs that one task may choose among; more are chosen in rounds over all tasks, with the same result.
ALONE = 1 << 17
#: ASCII white space, which parts words.
BLANK = r"[ \t\n\x0B\f\r]"
KEYS = [f"k{i}" for i in range(ORDERS)]
LOW7, TOP = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def word_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, key, n_words, words) of the rows that have a word: 32-bit hashes of
    the set of lower-cased words, in order, as bytes, and a 64-bit hash of the set. With
    ``texts``, the rows' texts too."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(chunk: pa.RecordBatch):
        row, _, _, _, hashes = words_of(pc.utf8_lower(strings(chunk.column(1))))
        if not len(row):
            return
        count = np.bincount(row, minlength=chunk.num_rows)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]
        row, hashes = row[new], hashes[new]
        full = np.flatnonzero(count)
        heads = np.searchsorted(row, full)
        key = np.add.reduceat(mix64(hashes ^ np.uint64(HASH_BASE)), heads).view(np.int64)
        offsets = (np.r_[heads, len(row)] * 4).astype(np.int32)
        sets = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer((hashes >> np.uint64(32)).astype(np.uint32))])
        made = [chunk.column(0).take(pa.array(full)), pa.array(key), pa.array(count[full].astype(np.int64)), sets, chunk.column(1).take(pa.array(full))]
        yield pa.RecordBatch.from_arrays(made[: len(names)], names)

    names = ["doc_id", "key", "n_words", "words", "text"][: 5 if texts else 4]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return map_text(rows, run, f"doc_id {kind}, key bigint, n_words bigint, words binary" + ", text string" * texts, limit=2 << 20)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of a binary column, and the words."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    return np.repeat(np.arange(len(column)), sizes), np.frombuffer(concatenated(column), np.uint32)


def weights(found: DataFrame) -> np.ndarray:
    """The weight of the words of each counter, from all rows of ``word_sets``."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount(_words(b.column(0))[1] % COUNTERS, minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["counter", "n"])

    rows = found.select("words").mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(COUNTERS)
    n[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return np.log1p(found.count() / n) ** 2


def sketch_of(row: np.ndarray, words: np.ndarray, n: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x ``BINS`` bytes, n x ``ORDERS`` sort keys) of sets that have a word. A byte stands for its
    bin's winner; where no word falls into a bin, the other bins' winners race once more for it,
    which makes sketches of small sets as exact as those of large ones. A key starts with the
    whole hash of one bin's winner and goes on with parts of two others'."""
    mixed = mix64(words.astype(np.uint64) * np.uint64(HASH_BASE) + np.uint64(1))
    bin_of = (mixed & np.uint64(BINS - 1)).astype(np.int64)
    time = -np.log(((mixed >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / weight[words % COUNTERS]
    entry = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | words  # times are positive, so their bits are in order
    best = np.full(n * BINS, np.iinfo(np.uint64).max)
    np.minimum.at(best, row * BINS + bin_of, entry)
    best = best.reshape(n, BINS)
    full = best != np.iinfo(np.uint64).max
    word = best & np.uint64(0xFFFFFFFF)
    scale = np.where(full, 1 / weight[(word % np.uint64(COUNTERS)).astype(np.int64)], np.inf).astype(np.float32)
    won = word.copy()
    for b in np.flatnonzero(~full.all(axis=0)).tolist():
        at = np.flatnonzero(~full[:, b])
        again = mix64(word[at] * np.uint64(HASH_BASE) + np.uint64(2 + b)) >> np.uint64(40)
        time = -np.log((again.astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24)) * scale[at]
        won[at, b] = word[at, time.argmin(axis=1)]
    winner = mix64(won + np.uint64(HASH_BASE))
    step = BINS // ORDERS
    lead = lambda at, bits: winner[:, at] >> np.uint64(64 - bits)
    keys = [(lead(i * step, 32) << np.uint64(32)) | (lead(i * step + step // 3, 16) << np.uint64(16)) | lead(i * step + 2 * step // 3, 16) for i in range(ORDERS)]
    return (winner & np.uint64(255)).astype(np.uint8), np.stack(keys, axis=1).view(np.int64)


def sketches(found: DataFrame) -> DataFrame:
    """(key, sketch, k0..): a row for each distinct set of ``found``."""
    shared = found.sparkSession.sparkContext.broadcast(weights(found).astype(np.float32))

    def run(batches):
        for b in batches:
            for part in text_chunks((b.slice(a, 2048) for a in range(0, b.num_rows, 2048)), 1, 1 << 20):
                row, words = _words(part.column(1))
                made, keys = sketch_of(row, words, part.num_rows, shared.value)
                offsets = (np.arange(part.num_rows + 1) * BINS).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(made.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), packed, *[pa.array(keys[:, i].copy()) for i in range(ORDERS)]], ["key", "sketch", *KEYS])

    return found.select("key", "words").mapInArrow(run, f"key bigint, sketch binary, {', '.join(f'{k} bigint' for k in KEYS)}").dropDuplicates(["key"])


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row, as eight bytes a number: the share of equal
    bytes, less what chance makes equal."""
    x = a ^ b
    equal = np.bitwise_count(~(((x & LOW7) + LOW7) | x | LOW7) & TOP).sum(axis=1, dtype=np.int32)
    return np.maximum((equal - BINS / 256) / (BINS - BINS / 256), 0).astype(np.float32)


def nearest_in_order(cell: np.ndarray, key: np.ndarray, sketch: np.ndarray, reach: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the k most alike of the ``reach`` rows before and after each row
    within its cell, similarity, 0 where there is none), nearer places first on ties."""
    n = len(key)
    score = np.zeros((n, 2 * reach), np.float32)
    for s in range(1, min(reach, n - 1) + 1):
        got = np.where(cell[s:] == cell[:-s], alike(sketch[s:], sketch[:-s]), np.float32(0))
        score[:-s, 2 * s - 2], score[s:, 2 * s - 1] = got, got
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    places = np.arange(n)[:, None] + np.where(best % 2 == 0, best // 2 + 1, -(best // 2 + 1))
    return np.clip(places, 0, max(n - 1, 0)), np.take_along_axis(score, best, axis=1)


def related(made: DataFrame, k: int = NEAREST, reach: int = REACH, cell_rows: int = CELL) -> DataFrame:
    """(key, near array<struct<d, other>>): the ``k`` nearest others that any order shows
    for each row of ``made`` (stashed ``sketches``), nearest first, ties by key; d is 1 less the
    estimated similarity. Sets with no more equal bins than chance gives are no pair.

    An order is cut into cells of some ``cell_rows`` rows at the keys of a sample by hash,
    so that the result depends on the rows alone. Keys that many sets share
    are cut by the sets' own hashes, so that every cell is small.
    """
    spark = made.sparkSession
    n = made.count()
    cells = max(1, min(MOST_CELLS, n // cell_rows))
    share = min(1.0, SAMPLE * cells / max(n, 1)) if cells > 1 else 0.0
    sample = made.select("key", *KEYS).filter(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    bounds = []
    for name in KEYS:
        x, y = sample.column(name).to_numpy(), sample.column("key").to_numpy()
        order = np.lexsort((y, x))
        cut = order[np.arange(1, cells) * len(order) // cells] if len(order) else order
        bounds.append((x[cut], y[cut]))
    shared = spark.sparkContext.broadcast(bounds)

    def spread(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            for i, (x, y) in enumerate(shared.value):
                own = b.column(2 + i).to_numpy()
                cell = np.searchsorted(x, own, "left")
                high = np.searchsorted(x, own, "right")
                for at in np.flatnonzero(high > cell):  # equal to a bound: the set's hash decides
                    cell[at] += np.searchsorted(y[cell[at] : high[at]], key[at], "right")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32) + ORDERS * cell.astype(np.int32)), pa.array(own), b.column(0), b.column(1)], ["cell", "k", "key", "sketch"])

    def compare(batches):
        held, known = None, 0  # rows whose followers aren't there yet, after some that are done
        for b in (*batches, None):
            if b is not None:
                new = [b.column(0).to_numpy(), b.column(2).to_numpy(), np.frombuffer(concatenated(b.column(3)), np.uint64).reshape(b.num_rows, BINS // 8)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None:
                return
            cell, key, sketch = held
            end = len(key) if b is None else max(known, len(key) - reach)
            if end > known:
                at, score = nearest_in_order(cell, key, sketch, reach, k)
                at, score = at[known:end], score[known:end]
                good = score > 0
                sizes = good.sum(axis=1)
                near = pa.StructArray.from_arrays([pa.array(1 - score[good]), pa.array(key[at[good]])], ["d", "other"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), near)
                yield pa.RecordBatch.from_arrays([pa.array(key[known:end]), lists], ["key", "near"])
            first = max(0, end - reach)
            held, known = [x[first:] for x in held], end - first

    placed = made.select("key", "sketch", *KEYS).mapInArrow(spread, "cell int, k bigint, key bigint, sketch binary")
    near = placed.repartition("cell").sortWithinPartitions("cell", "k", "key").mapInArrow(compare, "key bigint, near array<struct<d:float,other:bigint>>")
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return near.groupBy("key").agg(best.alias("near"))


def graph(near: DataFrame) -> DataFrame:
    """(u, v, degree, d): the undirected pairs of ``related`` (stashed), u < v, with the lower
    of the two degrees."""
    pairs = near.select("key", F.explode("near").alias("n")).select(F.least("key", "n.other").alias("u"), F.greatest("key", "n.other").alias("v"), "n.d").distinct()
    pairs = stash(pairs, "pairs")
    degree = stash(pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("n")), "degrees")
    of = lambda x: small_side(degree).select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", F.least("u_n", "v_n").alias("degree"), "d")


def choose(u: np.ndarray, v: np.ndarray, pu: np.ndarray, pv: np.ndarray, order: np.ndarray, ends: dict[int, tuple[int, int, int]], most: int) -> list[tuple[int, int, int, bool]]:
    """Greedy choice of pairs in ``order``. ``ends``: path to (first, last, words).
    (path, whole, place, turned) of each path that becomes part of a longer one."""
    parent = {p: p for p in ends}
    words = {p: w for p, (_, _, w) in ends.items()}
    free: dict[int, int] = {}
    for a, b, _ in ends.values():
        free[a], free[b] = (2, 2) if a == b else (1, 1)
    links: dict[int, list[tuple[int, int]]] = {}  # node: (other node, its path)

    def find(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for a, b, x, y in zip(u[order].tolist(), v[order].tolist(), pu[order].tolist(), pv[order].tolist()):
        if not free[a] or not free[b]:
            continue
        p, q = find(x), find(y)
        if p == q or words[p] + words[q] > most:
            continue
        low, high = min(p, q), max(p, q)
        parent[high] = low
        words[low] += words[high]
        free[a] -= 1
        free[b] -= 1
        links.setdefault(a, []).append((b, y))
        links.setdefault(b, []).append((a, x))
    out, seen = [], set()
    outer = {p: b if a in links and a != b else a for p, (a, b, _) in ends.items() if sum(len(links.get(x, ())) for x in {a, b}) == 1}
    for path in sorted(outer, key=outer.get):  # a path starts with the smaller of its ends
        if path in seen:
            continue
        came, before, place = outer[path], None, 0  # before: the node that came was reached from
        while True:
            first, last, _ = ends[path]
            out.append((path, find(path), place, first != last and came == last))
            seen.add(path)
            leave = last if came == first else first
            following = [x for x in links.get(leave, ()) if x[0] != before]
            if not following:
                break
            before, (came, path), place = leave, following[0], place + 1
    return out


def paths(nodes: DataFrame, edges: DataFrame, most: int = PATH_WORDS, alone: int = ALONE) -> DataFrame:
    """(path, key, place struct<at, pos>) of each node (key, words): greedy paths over
    ``edges`` (u, v, degree, d).

    Pairs are taken in the order of degree, d, u and v, if both nodes are ends of
    different paths that together have no more than ``most`` words. While there are more than
    ``alone`` pairs, all that come first for both their paths are taken at once, which gives the
    same paths, as nothing before them can touch these; then one task goes through the rest.
    ``path`` is its smallest node, and the smaller of its ends comes first.
    """
    now = stash(nodes.select(F.col("key").alias("path"), F.array("key").alias("seq"), "words"), "paths")
    live = edges.select("u", "v", "degree", "d")
    first, last = F.element_at("seq", 1), F.element_at("seq", -1)
    while True:
        ends = stash(now.select(F.explode(F.array_distinct(F.array(first, last))).alias("node"), "path", "words"), "ends")
        side = lambda x: small_side(ends).select(F.col("node").alias(x), F.col("path").alias(f"p{x}"), F.col("words").alias(f"w{x}"))  # noqa: B023, E731
        before = live
        live = stash(live.select("u", "v", "degree", "d").join(side("u"), "u").join(side("v"), "v").filter(f"pu <> pv AND wu + wv <= {most}").select("u", "v", "degree", "d", "pu", "pv"), "live")
        discard(ends)
        if hasattr(before, "stash_path"):
            discard(before)
        if live.count() <= alone:
            break
        best = live.select(F.explode(F.array("pu", "pv")).alias("path"), F.struct("degree", "d", "u", "v", "pu", "pv").alias("e")).groupBy("path").agg(F.min("e").alias("e"))
        taken = stash(best.groupBy("e").agg(F.count("*").alias("n")).filter("n = 2").select("e.*"), "taken")
        one = lambda x: now.select(F.col("path").alias(f"p{x}"), F.col("seq").alias(f"s{x}"), F.col("words").alias(f"w{x}"))  # noqa: B023, E731
        turned = lambda s, node, at: F.when(F.element_at(s, at) == F.col(node), F.col(s)).otherwise(F.reverse(s))
        joined = small_side(taken).join(one("u"), "pu").join(one("v"), "pv").select(F.least("pu", "pv").alias("path"), F.concat(turned("su", "u", -1), turned("sv", "v", 1)).alias("seq"), (F.col("wu") + F.col("wv")).alias("words"))
        joined = joined.withColumn("seq", F.when(first <= last, F.col("seq")).otherwise(F.reverse("seq")))
        gone = small_side(taken).select(F.explode(F.array("pu", "pv")).alias("path"))
        after = stash(now.join(gone, "path", "left_anti").unionByName(joined), "paths")
        for x in (taken, now):
            discard(x)
        now = after

    def finish(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        u, v, degree, d, pu, pv = (t.column(c).to_numpy() for c in ("u", "v", "degree", "d", "pu", "pv"))
        known = [np.concatenate(x) for x in zip(*([y.to_numpy() for y in t.column(e).combine_chunks().flatten()] for e in ("eu", "ev")))]
        once = np.unique(known[0], return_index=True)[1]
        ends = {p: (a, b, w) for p, a, b, w in zip(*(x[once].tolist() for x in known))}
        got = choose(u, v, pu, pv, np.lexsort((v, u, d, degree)), ends, most)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["path", "whole", "at", "turned"])

    side = lambda x: now.select(F.col("path").alias(f"p{x}"), F.struct("path", first.alias("first"), last.alias("last"), "words").alias(f"e{x}"))
    rest = live.join(side("u"), "pu").join(side("v"), "pv").select("u", "v", "degree", "d", "pu", "pv", "eu", "ev")
    tail = stash(rest.coalesce(1).mapInArrow(finish, "path bigint, whole bigint, at int, turned boolean"), "tail")
    whole = now.join(small_side(tail), "path", "left")
    seq = F.when(F.coalesce("turned", F.lit(False)), F.reverse("seq")).otherwise(F.col("seq"))
    return whole.select(F.coalesce("whole", "path").alias("path"), F.coalesce("at", F.lit(0)).alias("at"), F.posexplode(seq).alias("pos", "key")).select("path", "key", F.struct("at", "pos").alias("place"))


def pack(docs: DataFrame, window: int = WINDOW, k: int = NEAREST, most: int = PATH_WORDS, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(path, part, window, n_words, pieces array<struct<doc_id, first, last>>), a row for each window.

    A window holds ``window`` words between white space, the last one of a path
    what is left. ``pieces`` are in order; words ``first`` (from 0) to before
    ``last`` of the document are in this window, so that every word is in exactly one. With
    ``texts``, a piece has these words too, each with the white space after it.
    Documents of one word set, and repeated rows, follow each other by id, nulls first, then by length;
    where they alone have more than ``most`` words, they are parted by a hash of the id
    and length, else ``part`` is 0. A path ends with some ``most`` words. Null texts and those
    without a word are in no window; very long ones fill many. Only the two
    named columns are read. No words give no rows.
    """
    sets = stash(word_sets(docs, id_col, text_col, texts), "sets")
    found = sets.select("doc_id", "key", "n_words", *["text"] * texts) if texts else stash(sets.select("doc_id", "key", "n_words"), "found")
    made = stash(sketches(sets), "sketches")
    if not texts:
        discard(sets)
    near = stash(related(made, k), "near")
    discard(made)
    nodes = stash(found.groupBy("key").agg(F.sum("n_words").alias("words")), "nodes")
    walked = stash(paths(nodes, graph(near), most).join(nodes, "key"), "walked")
    parts = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(most)))
    part: Column = F.when(F.col("words") > most, F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "n_words"), parts)).otherwise(F.lit(0)).cast("int")
    joined = found.join(small_side(walked), "key").withColumn("part", part)
    order = Window.partitionBy("path", "part").orderBy("place", "doc_id", "n_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end, w = F.col("end"), F.lit(window).cast("bigint")
    start = end - F.col("n_words")
    laid = joined.withColumn("end", F.sum("n_words").over(order))
    if texts:
        laid = laid.withColumn("tokens", F.split(F.regexp_replace("text", f"^{BLANK}+", ""), f"(?<={BLANK})(?={BLANK.replace('[', '[^')})"))

    def cut(n: Column) -> Column:
        low, high = F.greatest(start, n * w), F.least(end, (n + 1) * w)
        words = [F.array_join(F.slice("tokens", (low - start + 1).cast("int"), (high - low).cast("int")), "").alias("text")] if texts else []
        return F.struct(n.alias("window"), low.alias("at"), "doc_id", (low - start).alias("first"), (high - start).alias("last"), *words)

    pieces = laid.select("path", "part", F.explode(F.transform(F.sequence(F.floor(start / w), F.floor((end - 1) / w)), cut)).alias("p"))
    shown = ["doc_id", "first", "last", *["text"] * texts]
    packed = pieces.groupBy("path", "part", F.col("p.window").alias("window")).agg(F.sum(F.col("p.last") - F.col("p.first")).alias("n_words"), F.sort_array(F.collect_list(F.struct("p.at", *[f"p.{c}" for c in shown]))).alias("pieces"))
    inner = lambda x: F.struct(*[x[c].alias(c) for c in shown])
    return packed.select("path", "part", "window", "n_words", F.transform("pieces", inner).alias("pieces"))
