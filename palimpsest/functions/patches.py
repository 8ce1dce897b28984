"""Text of patches: declarations, hunk headers, file diffs, patch logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from palimpsest.schemas import EOF_MARK

_RANGE = re.compile(rb"^([-+])(\d+)(?:,(\d+))?$")
_MERGE_RECORD = re.compile(rb"^commit (\S+)(?: \(from (\S+)\))?$")
_META = {b"rename from ": "from", b"rename to ": "to", b"new file ": "new", b"deleted file ": "deleted", b"Binary files ": "binary"}
_META_STARTS = tuple(_META)


class PatchError(ValueError):
    """Text that isn't a patch of the expected form."""


class Range(NamedTuple):
    added: bool
    offset: int
    lines: int


class Hunk(NamedTuple):
    ranges: tuple[Range, ...]
    lines: tuple[bytes, ...]


class FileDiff(NamedTuple):
    before: str = ""
    after: str = ""
    binary: bool = False
    hunks: tuple[Hunk, ...] = ()


class Record(NamedTuple):
    sha: str
    against: str
    changes: tuple[bytes, ...]


def text_lines(data: bytes) -> list[bytes]:
    """Lines without their ends, and without a carriage return before them."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [x[:-1] if x.endswith(b"\r") else x for x in lines] if b"\r" in data else lines


@lru_cache(4096)
def hunk_header(line: bytes) -> tuple[Range, ...]:
    """The ranges between the marks. A number without a comma is a count of
    lines, its offset is 0; what follows the closing mark is a heading."""
    marks = len(line) - len(line.lstrip(b"@"))
    head, closing, _ = line[marks:].partition(b"@" * marks) if marks else (b"", b"", b"")
    if not closing:
        raise PatchError(f"no hunk header: {line!r}")
    out = []
    for part in head.split():
        m = _RANGE.match(part)
        if not m:
            raise PatchError(f"no range in hunk header: {line!r}")
        sign, first, second = m.groups()
        out.append(Range(sign == b"+", int(first) if second is not None else 0, int(second if second is not None else first)))
    if not out:
        raise PatchError(f"no range in hunk header: {line!r}")
    return tuple(out)


@lru_cache(4096)
def declared_paths(line: bytes) -> tuple[str, str] | None:
    """Both paths of a ``diff --git`` line; None where only later lines tell
    them: combined diffs, and names with spaces that differ."""
    if line.startswith(b"diff --combined "):
        return None
    if not line.startswith(b"diff --git ") or b" " not in line[11:]:
        raise PatchError(f"no diff declaration: {line!r}")
    names = line[11:]
    if names.count(b" ") == 1:
        return tuple(_unprefixed(n, p, line) for n, p in zip(names.split(b" "), (b"a/", b"b/")))
    half = len(names) // 2
    if len(names) < 7 or len(names) % 2 == 0 or not names.startswith(b"a/") or names[half + 1 : half + 3] != b"b/" or names[2:half] != names[half + 3 :]:
        return None
    return (_text(names[2:half]),) * 2


def _unprefixed(name: bytes, prefix: bytes, line: bytes) -> str:
    if len(name) > 1 and name[:1] == name[-1:] == b'"':
        name = name[1:-1]
    if not name.startswith(prefix) or len(name) == len(prefix):
        raise PatchError(f"no {prefix!r} in diff declaration: {line!r}")
    return _text(name[len(prefix) :])


def _text(name: bytes) -> str:
    return name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")


def file_diff(data: bytes) -> FileDiff:
    """A file's part of a patch. A new file has no ``before``, a deleted one
    no ``after`` and no hunks; a rename's own lines win over the declaration."""
    lines = text_lines(data)
    if not data:
        return FileDiff()
    before, after = declared_paths(lines[0]) or ("", "")
    told: dict[str, bytes] = {}
    at = 1
    while at < len(lines) and not lines[at].startswith(b"---"):
        if lines[at].startswith(_META_STARTS):
            for start, name in _META.items():
                if lines[at].startswith(start):
                    told[name] = lines[at][len(start) :]
        at += 1
    hunks: list[tuple[tuple[Range, ...], list[bytes]]] = []
    for line in lines[at + 2 :]:
        if line.startswith(b"@@"):
            hunks.append((hunk_header(line), []))
        elif hunks:
            hunks[-1][1].append(line)
    if told.get("new"):
        before = ""
    if told.get("deleted"):
        after, hunks = "", []
    if told.get("from"):
        if not told.get("to"):
            raise PatchError(f"a rename without a new name: {lines[0]!r}")
        before, after = _text(told["from"]), _text(told["to"])
    return FileDiff(before, after, bool(told.get("binary")), tuple(Hunk(r, tuple(x)) for r, x in hunks))


def patch_log(lines: Iterable[bytes]) -> Iterator[Record]:
    """Records of a patch log, one for each commit and, in merges, parent. Every
    commit comes once, also the last one before a blank line."""
    sha = against = None
    changes: list[list[bytes]] = []
    in_diff = False
    for raw in lines:
        line = raw.rstrip(b"\n")
        if line.startswith(b"commit "):
            if sha is not None:
                yield Record(sha, against, tuple(b"\n".join(c) + b"\n" for c in changes))
            m = _MERGE_RECORD.match(line)
            if not m:
                raise PatchError(f"no commit line: {line!r}")
            sha, against = m.group(1).decode(), (m.group(2) or b"").decode()
            changes, in_diff = [], False
        elif sha is None:
            if line:
                raise PatchError(f"text before the first commit: {line!r}")
        elif line.startswith(b"diff "):
            changes.append([line])
            in_diff = True
        elif in_diff and line:
            changes[-1].append(line)
        elif not line:
            in_diff = False
        # what remains is the author or the message
    if sha is not None:
        yield Record(sha, against, tuple(b"\n".join(c) + b"\n" for c in changes))


def is_end_mark(line: bytes) -> bool:
    return line == EOF_MARK
