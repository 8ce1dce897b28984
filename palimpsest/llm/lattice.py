"""Operator 1, language-model scoring over the lattice of subword segmentations.

A vocabulary gives every piece a weight. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities: the
forward recursion in log space. No piece goes beyond a word, so a document's
log-probability is the sum over its words, and its rank among all documents of
its language tells how usual it is there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.arrow import HashCache, PolyHash, codepoints, map_text, words_of
from palimpsest.storage import small_side, stash

SPACE = "▁"
#: Words beyond this go by parts, of this many characters.
LONG_WORD, PART = 96, 1 << 15
#: Characters whose arcs are held at a time.
ARCS_OF = 1 << 18
_caches: dict[int, HashCache] = {}


class Pieces:
    """Pieces with their log-probabilities, as sorted hashes of their characters.

    A vocabulary of merges has ranks for scores (0, -1, -2, ...); they become
    Zipf's probabilities, 1 / (rank + 3) over their sum. Other scores are taken as
    log-probabilities as they are. ``byte`` is that of one byte of a character
    that is spelt in bytes; every character can be, so every word has a segmentation.
    """

    def __init__(self, pieces: list[str], scores: list[float]):
        kept = {p: s for p, s in sorted(zip(pieces, scores), key=lambda x: x[1]) if p and s > -1e8}
        names, given = list(kept), np.array(list(kept.values()), float)
        if len(given) and np.all(given == np.round(given)):
            weights = 1 / (3 - given)
            byte = 1 / (4 - given.min())
            self.byte = math.log(byte / (weights.sum() + 256 * byte))
            given = np.log(weights / (weights.sum() + 256 * byte))
        else:
            self.byte = float(given.min()) - 1 if len(given) else math.log(1 / 256)
        points, offsets = codepoints(pa.array(names, pa.string()))
        keys = PolyHash(points)(offsets[:-1], offsets[1:])
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], given[order]
        self.longest = int(np.diff(offsets).max()) if len(names) else 1
        # A first look-up by 20 bits answers most of the misses.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.slot(keys)] = True
        self.version = hash((tuple(names[:50]), len(names), float(given.sum())))

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``keys`` of each that is a piece, its log-probability)."""
        maybe = np.flatnonzero(self.filter[self.slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[hit], self.weights[at[hit]]


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model, without control and byte pieces, or those of a
    text file with a piece, a tab and its log-probability in each line, as such models
    come with (its lines in angle brackets are left out). Scores are taken as ``Pieces`` says."""
    if path.endswith((".vocab", ".tsv", ".txt")):
        with open(path, encoding="utf-8") as f:
            rows = [line.rstrip("\n").rpartition("\t") for line in f]
        rows = [(p, float(x)) for p, _, x in rows if p and not (p[0] == "<" and p[-1] == ">")]
        return Pieces([p for p, _ in rows], [x for _, x in rows])
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Pieces([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids])


def _arcs(pieces: Pieces, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log-probability of the arc of length l + 1 that ends with character j, at [l, j]."""
    n = len(points)
    arcs = np.full((pieces.longest, n), -np.inf)
    hashed, start = PolyHash(points), np.repeat(offsets[:-1], np.diff(offsets))
    ends = np.arange(n) + 1
    spelt = pieces.byte * (1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
    for span in range(1, pieces.longest + 1):
        e = ends[ends - span >= start]
        if not len(e):
            break
        at, weight = pieces.look_up(hashed(e - span, e))
        arcs[span - 1, e[at] - 1] = weight
    arcs[0] = np.logaddexp(arcs[0], spelt)
    return arcs


def word_scores(pieces: Pieces, words: pa.Array) -> np.ndarray:
    """log-probability of each word, with the mark of a word's start before it."""
    if not len(words):
        return np.zeros(0)
    words = pc.binary_join_element_wise(pa.scalar(SPACE), words, "")
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    long = sizes > LONG_WORD
    out = np.zeros(len(words))
    for w in np.flatnonzero(long):
        out[w] = _long_word(pieces, codepoints(words.slice(w, 1))[0])
    short = np.flatnonzero(~long)
    if not len(short):
        return out
    points, offsets = codepoints(words.take(pa.array(short)))
    arcs, sizes = _arcs(pieces, points, offsets), sizes[short]
    order = np.argsort(-sizes, kind="stable")
    live = sizes[order]
    alpha = np.full((int(live[0]) + 1, len(order)), -np.inf)
    alpha[0] = 0
    for j in range(1, len(alpha)):
        m = int(np.searchsorted(-live, -j, "right"))  # the words of j characters or more
        end = offsets[:-1][order[:m]] + j - 1
        spans = min(j, pieces.longest)
        steps = alpha[j - spans : j, :m][::-1] + arcs[:spans, end]
        top = steps.max(axis=0)
        alpha[j, :m] = top + np.log(np.exp(steps - top).sum(axis=0))
    out[short[order]] = alpha[live, np.arange(len(order))]
    return out


def _long_word(pieces: Pieces, points: np.ndarray) -> float:
    """A word of any length, by parts of ``PART`` characters that overlap by the longest
    piece, so that what is held doesn't grow with it."""
    reach = pieces.longest
    alpha = [0.0]  # of the last places before the part
    for a in range(0, len(points), PART):
        low = max(0, a - reach + 1)
        part = points[low : a + PART]
        arcs = _arcs(pieces, part, np.array([0, len(part)]))
        alpha = alpha[-(a - low + 1) :]
        spans, ends = np.nonzero(np.isfinite(arcs[:, a - low :]))
        order = np.argsort(ends, kind="stable")
        alpha += [-math.inf] * (len(part) - (a - low))
        ends = ends[order] + a - low
        for span, end, weight in zip(spans[order].tolist(), ends.tolist(), arcs[spans[order], ends].tolist()):
            x, y = alpha[end + 1], alpha[end - span] + weight
            if y > x:
                x, y = y, x
            alpha[end + 1] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
    return alpha[-1]


def _text_scores(pieces: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    row, words, _, _, hashes = words_of(texts)
    keys, first, each = np.unique(hashes, return_index=True, return_inverse=True)
    cache = _caches.setdefault(pieces.version, HashCache(np.float64))
    at, known = cache.find(keys)
    values = np.zeros(len(keys))
    values[known] = cache.values[at[known]]
    new = np.flatnonzero(~known)
    some = words.take(pa.array(first[new]))
    upto = np.cumsum(np.minimum(pc.utf8_length(some).to_numpy(zero_copy_only=False), LONG_WORD).astype(np.int64))
    a = 0
    while a < len(new):  # words of so many characters at a time, which bounds the arcs that are held
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ARCS_OF, "right")))
        values[new[a:b]] = word_scores(pieces, some.slice(a, b - a))
        a = b
    if len(new):
        if len(cache.keys) + len(new) > cache.limit:
            cache.clear()
        cache.add(keys[new], values[new])
    return np.bincount(row, weights=values[each], minlength=len(texts)), np.bincount(row, minlength=len(texts))


def lattice_scores(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", by: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, n_chars, log_prob, per_char), a row for each row of ``docs``.

    ``log_prob`` is the natural logarithm of the document's probability, summed
    over all segmentations of each of its words; ``per_char`` is that over the
    number of characters. An empty text or one of white space has log_prob 0 and
    no words; with a null text all figures are null. Texts are scored whole.
    Repeated rows repeat; only the three named columns are read.
    """
    kind, lang = (docs.select(c).schema[0].dataType.simpleString() for c in (id_col, by))

    def run(chunk: pa.RecordBatch):
        texts = chunk.column(1)
        plain = pc.fill_null(texts, "")
        score, n = _text_scores(pieces, plain)
        chars = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        gone = pc.is_null(texts).to_numpy(zero_copy_only=False)
        made = [pa.array(v, t, mask=gone) for v, t in ((n, pa.int64()), (chars, pa.int64()), (score, pa.float64()), (score / np.maximum(chars, 1), pa.float64()))]
        yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), *made], ["doc_id", "lang", "n_words", "n_chars", "log_prob", "per_char"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(by).alias("lang"))
    return map_text(rows, run, f"doc_id {kind}, lang {lang}, n_words bigint, n_chars bigint, log_prob double, per_char double")


def ranked_scores(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", by: str = "lang") -> DataFrame:
    """``lattice_scores`` with each row's place among all rows of its language:
    ``rank`` from 1, the least probable a character first, and ``n_in_lang``.

    Ties go by doc_id, nulls first; equal rows take following places. A null
    language is one of its own. Places come from one range-partitioned sort and
    the sizes of its parts, so that no language has to fit one task.
    """
    scored = stash(lattice_scores(docs, pieces, id_col, text_col, by), "scored")
    keys = ["lang", "per_char", "doc_id"]
    placed = stash(scored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part"), "lang").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("lang").orderBy("part")
    sizes = sizes.withColumn("shift", F.sum("n").over(before) - F.col("n") - F.col("first")).withColumn("n_in_lang", F.sum("n").over(Window.partitionBy("lang")))
    sizes = small_side(stash(sizes.select("part", F.col("lang").alias("s_lang"), "shift", "n_in_lang"), "sizes"))
    joined = placed.withColumn("p", part).join(sizes, (F.col("p") == F.col("part")) & F.col("lang").eqNullSafe(F.col("s_lang")))
    return joined.select("doc_id", "lang", "n_words", "n_chars", "log_prob", "per_char", (F.col("at") + F.col("shift") + 1).alias("rank"), "n_in_lang")


def score_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    return ranked_scores(docs, read_pieces(model_path))
