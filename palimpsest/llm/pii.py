"""Operator 7, personal data: expressions propose spans, validators confirm
them, words nearby adjust the score.

A proposal that fails its validator (Luhn for cards, mod-97 for IBANs, octets
for addresses) is dropped. Others start with their kind's score, which rises
with a word that announces such data and falls with one that denies it, within
``CONTEXT`` characters before or after. Spans of ``THRESHOLD`` or more count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrow import text_chunks

THRESHOLD, CONTEXT = 0.5, 40


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def mod97(text: str) -> bool:
    plain = re.sub(r"[\s-]", "", text)
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def octets(text: str) -> bool:
    return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in text.split("."))


def phone_like(text: str) -> bool:
    return 9 <= sum(c.isdigit() for c in text) <= 15


def social(text: str) -> bool:
    a, b, c = text.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def any_text(_: str) -> bool:
    return True


class Rule(NamedTuple):
    kind: str
    pattern: re.Pattern
    valid: object
    score: float
    near: re.Pattern


def _near(words: str) -> re.Pattern:
    return re.compile(rf"(?i)\b(?:{words})\b")


#: Tried in this order; a span that overlaps an earlier rule's isn't proposed again.
RULES = (
    Rule("email", re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*([A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"), any_text, 0.9, _near("e-?mail|contact|write|correo|courriel")),
    Rule("secret", re.compile(r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+.]{12,}=*)"), any_text, 0.9, _near("token|secret|key|password")),
    Rule("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"), any_text, 0.9, _near("token|secret|key|password")),
    Rule("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), mod97, 0.8, _near("iban|account|konto|cuenta|compte|bank")),
    Rule("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"), luhn, 0.7, _near("card|visa|credit|karte|carte|tarjeta|payment")),
    Rule("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), social, 0.5, _near("ssn|social security|social")),
    Rule("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), octets, 0.6, _near("ip|address|host|server|login")),
    Rule("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"), phone_like, 0.7, _near("phone|tel|call|mobile|fax|telefon|téléphone|teléfono")),
    Rule("phone", re.compile(r"(?<![\w+.-])(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d.-])"), phone_like, 0.5, _near("phone|tel|call|mobile|fax|telefon|téléphone|teléfono")),
)
#: Kinds whose pattern may take neighbouring groups along, and how many signs their spans have.
CUT = {"card": (13, 19), "iban": (15, 34)}
AGAINST = _near("version|isbn|issn|doi|order|invoice|part|serial|example")
#: The first look, in parts of which each rule's pattern plainly holds one: an at sign, two
#: digits with at most one sign between, a key's first letters, or a word that names a secret.
HINT = r"@|\p{Nd}[ .-]?\p{Nd}|AKIA|gh[pousr]_|sk-|xox[abprs]-|(?i:key|token|secret|passw|pwd)"


def _cuts(rule: Rule, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The longest valid part of a span that starts with one of its groups and
    ends with one, of those the first; groups are what separators divide."""
    groups = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^ -]+", text[a:b])]
    upto = [0]
    for start, end in groups:
        upto.append(upto[-1] + end - start)
    least, most = CUT[rule.kind]
    some = ((i, j) for i in range(len(groups)) for j in range(i, len(groups)) if least <= upto[j + 1] - upto[i] <= most)
    parts = sorted(((groups[i][0], groups[j][1]) for i, j in some), key=lambda x: (x[0] - x[1], x[0]))
    return next(((x, y) for x, y in parts if rule.valid(text[x:y]) and rule.pattern.fullmatch(text[x:y])), None)


def _proposals(rule: Rule, text: str):
    """Valid spans of a rule, in order. What is left of a span after its valid
    part, or after its first group if no part is valid, is searched again."""
    at = 0
    while m := rule.pattern.search(text, at):
        a, b = m.span(1) if rule.pattern.groups else m.span()
        if rule.valid(text[a:b]):
            yield a, b
            at = max(m.end(), at + 1)
        elif rule.kind not in CUT:
            at = max(m.end(), at + 1)
        elif cut := _cuts(rule, text, a, b):
            yield cut
            at = cut[1]
        else:
            at = a + len(re.match(r"[^ -]+", text[a:b])[0])


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans of a text, in order."""
    found: list[tuple[int, int, str, float]] = []  # by place, without overlaps
    for rule in RULES:
        for a, b in _proposals(rule, text):
            at = bisect_left(found, (a,))
            taken = (at and found[at - 1][1] > a) or (at < len(found) and found[at][0] < b)
            if taken:
                continue
            around = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
            score = round(min(1.0, rule.score + 0.1 * bool(rule.near.search(around)) - 0.2 * bool(AGAINST.search(around))), 2)
            if score >= THRESHOLD:
                found.insert(at, (a, b, rule.kind, score))
    return [(kind, a, b, score) for a, b, kind, score in found]


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at = [], 0
    for kind, a, b, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _with_hint(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row: the text with each span replaced by
    its kind in brackets, and where the spans were, in characters of the given text.

    Texts are read whole. A null text stays null; without a span the text is
    unchanged and the list empty. Rows are treated one by one, in any number;
    other columns aren't read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for chunk in text_chunks(batches, 1):
            texts, spans = _clean(chunk.column(1))
            yield pa.RecordBatch.from_arrays([chunk.column(0), texts, pa.array(spans, SPAN)], ["doc_id", "text", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def _clean(texts: pa.Array) -> tuple[pa.Array, list[list]]:
    texts = texts.cast(pa.string())
    spans: list[list] = [[] for _ in range(len(texts))]
    changed: dict[int, str] = {}
    for i in _with_hint(texts).tolist():
        text = texts[i].as_py()
        if got := find(text):
            spans[i], changed[i] = [dict(zip(("kind", "start", "end", "score"), x)) for x in got], redacted(text, got)
    if changed:
        mask = np.zeros(len(texts), bool)
        mask[list(changed)] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(changed.values()), pa.string()))
    return texts, spans


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced; all columns and rows
    stay, whatever the columns' names, as ``annotate`` says."""
    at = docs.columns.index(text_col)

    def run(batches):
        for chunk in text_chunks(batches, at):
            columns = list(chunk.columns)
            columns[at] = _clean(columns[at])[0]
            yield pa.RecordBatch.from_arrays(columns, schema=chunk.schema.set(at, pa.field(chunk.schema.names[at], pa.string())))

    return docs.mapInArrow(run, docs.schema)
