"""Line provenance: which commit each line of each file version comes from.

A repository's patches are folded in history order. A partition holds whole
repositories, sorted, and streams them; a repository's edges come first, and a commit's
files are let go once its last child is folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.patches import FileDiff, PatchError, file_diff, is_end_mark
from palimpsest.schemas import BLAME


class Blame(NamedTuple):
    """A file version: its lines and the commit that each came with."""

    commit: str
    lines: tuple[bytes, ...] = ()
    owners: tuple[str, ...] = ()
    binary: bool = False


class HistoryError(ValueError):
    """A patch that doesn't fit the history before it."""


Tree = dict[str, Blame]
LINES = "array<struct<line:binary,commit:string>>"


def apply_diff(old: Blame, diff: FileDiff, commit: str) -> Blame:
    """The version after a diff. Context lines are taken from the old version."""
    if old.binary or diff.binary:
        raise HistoryError(f"{commit}: a binary version has no lines")
    lines: list[bytes] = []
    owners: list[str] = []
    known = len(old.lines)
    start = at = 0  # old lines from start to at are kept, but not yet copied

    def copy() -> None:
        lines.extend(old.lines[start:at])
        owners.extend(old.owners[start:at])

    def keep(to: int) -> None:
        nonlocal at
        if not at <= to <= known:
            raise HistoryError(f"{commit} {diff.after}: line {to} of {known}")
        at = to

    for hunk in diff.hunks if len(diff.hunks) < 2 else sorted(diff.hunks, key=lambda h: h.ranges[0].offset):
        keep(max(0, hunk.ranges[0].offset - 1))
        for line in hunk.lines:
            sign = line[:1]
            if sign == b" " or sign == b"\t":
                if at >= known:
                    keep(at + 1)
                at += 1
            elif sign == b"-":
                if start < at:
                    copy()
                start = at = at + 1
            elif sign == b"+":
                if start < at:
                    copy()
                    start = at
                lines.append(line[1:])
                owners.append(commit)
            elif not is_end_mark(line):
                raise PatchError(f"{commit} {diff.after}: {line!r}")
    keep(known)
    copy()
    return Blame(commit, tuple(lines), tuple(owners))


def apply_merge(parents: list[Blame], diffs: list[FileDiff], commit: str) -> Blame:
    """A line belongs to whom the first parent that had it says, else to the merge."""
    views = [apply_diff(p, d, commit) for p, d in zip(parents, diffs)]
    if len({len(v.lines) for v in views}) > 1:
        raise HistoryError(f"{commit}: parents lead to versions of {[len(v.lines) for v in views]} lines")
    owners = tuple(next((o for o in each if o != commit), commit) for each in zip(*(v.owners for v in views)))
    return Blame(commit, views[0].lines, owners)


class Fold:
    """One repository's history, commit by commit.

    ``full_blame`` (commit, path) gives a version whose parent was binary; without it
    such a version's lines all belong to the commit.
    """

    def __init__(self, full_blame: Callable[[str, str], Blame] | None = None, trees: dict[str, Tree] | None = None):
        self.trees: dict[str, Tree] = dict(trees or {})
        self.full_blame = full_blame

    def tree(self, commit: str) -> Tree:
        if commit not in self.trees:
            raise HistoryError(f"{commit} isn't in the state")
        return self.trees[commit]

    def step(self, commit: str, parents: list[str], parts: dict[str, list[FileDiff]]) -> Tree:
        """``parts``: the diffs against each parent, "" where it isn't named. Returns what is shown."""
        if len(parents) > 1:
            return self._merge(commit, parents, parts)
        return self._plain(commit, parents, [d for ds in parts.values() for d in ds])

    def _plain(self, commit: str, parents: list[str], diffs: list[FileDiff]) -> Tree:
        before = self.tree(parents[0]) if parents else {}
        shown: Tree = {}
        now = dict(before)
        for d in diffs:
            if d.before and d.before != d.after:
                now.pop(d.before, None)
        for d in diffs:
            old = before.get(d.before) if d.before else None
            if not d.after:
                shown[d.before] = Blame(commit, binary=d.binary)
                continue
            if d.binary:
                new = Blame(commit, binary=True)
            elif d.before and d.before != d.after and not d.hunks and old is not None and old.binary:
                new = old  # a binary file under a new name is the same version
            elif old is not None and old.binary:
                new = self.full_blame(commit, d.after) if self.full_blame else apply_diff(Blame(commit), d, commit)
            else:
                new = apply_diff(old or Blame(commit), d, commit)
            now[d.after] = shown[d.after] = new
        self.trees[commit] = now
        return shown

    def _merge(self, commit: str, parents: list[str], parts: dict[str, list[FileDiff]]) -> Tree:
        trees = [self.tree(p) for p in parents]
        place = {p: i for i, p in enumerate(parents)}
        changed: dict[str, list[FileDiff | None]] = {}
        gone: set[str] = set()
        for parent, diffs in parts.items():
            for d in diffs:
                if d.after:
                    changed.setdefault(d.after, [None] * len(parents))[place.get(parent, 0)] = d
                else:
                    gone.add(d.before)
        now: Tree = {}
        for tree in trees:  # the first parent that has a file
            for path, version in tree.items():
                now.setdefault(path, version)
        shown: Tree = {}
        for path in gone:
            now.pop(path, None)
            shown[path] = Blame(commit)
        for path, diffs in changed.items():
            olds = [t.get(d.before) if d and d.before else t.get(path) if d is None else None for t, d in zip(trees, diffs)]
            same = next((o for o, d in zip(olds, diffs) if d is None and o is not None), None)
            if any(d and d.binary for d in diffs) or any(o is not None and o.binary for o, d in zip(olds, diffs) if d):
                now[path] = shown[path] = Blame(commit, binary=True)
            elif same is not None:
                now[path] = same  # as one parent has it
            else:
                if any(o is None and (d is None or d.before) for o, d in zip(olds, diffs)):
                    raise HistoryError(f"{commit} {path}: a parent lacks the file")
                now[path] = shown[path] = apply_merge([o or Blame(commit) for o in olds], [d or FileDiff() for d in diffs], commit)
        self.trees[commit] = now
        return shown

    def forget(self, commit: str) -> None:
        self.trees.pop(commit, None)


COLUMNS = ("repo", "kind", "sha", "parent", "parent_ix", "parents", "uses", "diff_from", "diff", "path", "blame_commit", "is_binary", "lines")
#: Kinds of rows, as they come in each repository: its graph, the commits to be folded (if there is a state), the state, the patches.
EDGE, KEY, STATE, PATCH = range(4)


def column_values(column: pa.Array) -> list:
    """A column as Python values; lists of lines and their commits as pairs of tuples."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_list(column.type) and not pa.types.is_struct(column.type.value_type):
        inner = column.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = list(accumulate((n or 0 for n in column.value_lengths().to_pylist()), initial=0))
        return [inner[a:b] for a, b in zip(ends, ends[1:])]
    if pa.types.is_list(column.type):
        texts, commits = map(column_values, column.flatten().flatten())
        out, at = [], 0
        for n in column.value_lengths().to_pylist():
            out.append((tuple(texts[at : at + (n or 0)]), tuple(commits[at : at + (n or 0)])))
            at += n or 0
        return out
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


class Graph:
    """One repository's edges: a commit's parents in order, and how many children it has."""

    def __init__(self):
        self.edges: dict[str, list[tuple[int | None, str]]] = {}
        self.uses: dict[str, int] = {}
        self.keys: set[str] = set()
        self.later: dict[str, int] = {}

    def add(self, child: str, parent_ix: int | None, parent: str) -> None:
        self.edges.setdefault(child, []).append((parent_ix, parent))
        self.uses[parent] = self.uses.get(parent, 0) + 1

    def expect(self, sha: str, parents: list[str] | None = None) -> None:
        """A commit that will be folded; ``later`` has how many of them a commit is parent of."""
        if sha not in self.keys:
            self.keys.add(sha)
            for p in (p for _, p in self.edges.get(sha, ())) if parents is None else parents:
                self.later[p] = self.later.get(p, 0) + 1

    def parents(self, sha: str) -> list[str]:
        edges = self.edges.get(sha, ())
        if len(edges) > 1:
            edges = sorted(set(edges), key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        return [p for _, p in edges]


def _history(batches) -> Iterator[tuple]:
    """Commits of sorted rows (those of ``COLUMNS`` that they need): (repo, sha, graph, diffs by parent,
    versions of the state or None, parents and uses if the rows tell them)."""
    now = graph = at = None
    for b in batches:
        has = set(b.schema.names)
        columns = [column_values(b.column(c)) if c in has else repeat(None) for c in COLUMNS]
        for repo, kind, sha, parent, parent_ix, parents, uses, diff_from, diff, path, commit, binary, lines in zip(*columns):
            if repo != at or graph is None:
                if now is not None:
                    yield now
                now, graph, at = None, Graph(), repo
            if kind == EDGE:
                graph.add(sha, parent_ix, parent)
                continue
            if kind == KEY:
                graph.expect(sha, parents)
                continue
            if now is None or now[1] != sha or (now[4] is None) != (kind == PATCH):
                if now is not None:
                    yield now
                now = (repo, sha, graph, {}, {} if kind == STATE else None, parents, uses)
            if kind == STATE:
                if path:
                    now[4][path] = Blame(commit, *(lines or ()), binary=binary)
                continue
            diffs = now[3].setdefault(diff_from or "", [])
            if diff is not None:
                diffs.append(diff)
    if now is not None:
        yield now


def blame_rows(rows: list[tuple[str, str, str, Blame, bool]]) -> pa.RecordBatch:
    blames = [r[3] for r in rows]
    ends = pa.array(list(accumulate((len(b.lines) for b in blames), initial=0)), pa.int32())
    parts = [pa.array([x for b in blames for x in b.lines], pa.binary()), pa.array([x for b in blames for x in b.owners], pa.string())]
    lines = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["line", "commit"]))
    texts = [pa.array(v, pa.string()) for v in ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [b.commit for b in blames])]
    flags = [pa.array(v, pa.bool_()) for v in ([b.binary for b in blames], [r[4] for r in rows])]
    return pa.RecordBatch.from_arrays([*texts, flags[0], lines, flags[1]], ["repo", "sha", "path", "blame_commit", "is_binary", "lines", "live"])


def fold_history(patches: DataFrame, edges: DataFrame | None, state: DataFrame | None = None, keep: int = 1000, full_blame: Callable[[str, str, str], Blame] | None = None, rows: tuple[bool, ...] = (False, True), parts: int | None = None) -> DataFrame:
    """Schema ``BLAME`` and ``live``: the shown versions of each commit, and with
    ``live`` the whole trees of the commits that later ones may build on. ``rows``: which of
    them, by ``live``.

    ``state`` has the live rows of an earlier fold. ``keep``: finished commits that
    stay in memory for late children, as the graph may grow later. Repositories are
    the unit of parallel work: one shuffle of edges, state and patches by repository (into
    ``parts`` parts if given, so that a part stays small whatever the input), then a stream of its rows.
    Without ``edges``, ``patches`` has each commit's ``parents`` (array, in order) and ``uses`` (of how
    many edges it is the parent): rows of their own for edges would be made, sorted and sent beside them.
    """

    def run(batches):
        fold, repo, left, done, out, held = Fold(), None, {}, [], [], 0

        def finish():
            live = [c for c in fold.trees if left.get(c, 1) > 0] if True in rows else []
            return [(repo, c, path, b, True) for c in live for path, b in sorted(fold.trees[c].items())] + [(repo, c, "", Blame(c), True) for c in live if not fold.trees[c]]

        for name, sha, graph, by_parent, old, told, uses in _history(batches):
            if name != repo:
                ended = finish() if repo is not None else []
                out += ended
                held += sum(len(r[3].lines) for r in ended)
                fold = Fold((lambda c, p, r=name: full_blame(r, c, p)) if full_blame else None)
                repo, left, done = name, {}, []
            if old is not None:
                fold.trees[sha] = old
                left[sha] = graph.later.get(sha, 1)
                continue
            parents = graph.parents(sha) if told is None else told
            shown = fold.step(sha, parents, {k: [file_diff(d) for d in v] for k, v in by_parent.items()})
            left[sha] = graph.uses.get(sha, 1) if told is None else uses or 1  # a head may get children later
            for p in parents:
                left[p] = left.get(p, 1) - 1
                if left[p] <= 0:
                    done.append(p)
            while len(done) > keep:
                fold.forget(done.pop(0))
            if False in rows:
                for path, b in sorted(shown.items()) if len(shown) > 1 else shown.items():
                    out.append((name, sha, path, b, False))
                    held += len(b.lines)
            if held > 50_000 or len(out) > 2000:
                yield blame_rows(out)
                out, held = [], 0
        out += finish() if repo is not None else []
        if out:
            yield blame_rows(out)

    needed = {"sha": "string", "seq": "bigint", "change_ix": "int"}
    needed |= {"parents": "array<string>", "uses": "int"} if edges is None else {"parent": "string", "parent_ix": "int"}
    needed |= {"diff_from": "string", "diff": "binary"}
    if state is not None:
        needed |= {"path": "string", "blame_commit": "string", "is_binary": "boolean", "lines": LINES}

    def of(kind: int, frame: DataFrame, *columns: str) -> DataFrame:
        return frame.select("repo", F.lit(kind).alias("kind"), *[(F.col(c) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in needed.items()])

    told = ("parents",) if edges is None else ()
    all_rows = of(PATCH, patches, "sha", "seq", "diff_from", "change_ix", "diff", *told, *(("uses",) if told else ()))
    if edges is not None:
        known = edges.filter("parent IS NOT NULL").select("repo", F.col("child").alias("sha"), "parent", "parent_ix")
        all_rows = of(EDGE, known, "sha", "parent", "parent_ix").unionByName(all_rows)
    if state is not None:
        all_rows = all_rows.unionByName(of(KEY, patches, "sha", *told)).unionByName(of(STATE, state, "sha", "path", "blame_commit", "is_binary", "lines"))
    apart = all_rows.repartition(parts, "repo") if parts else all_rows.repartition("repo")
    return apart.sortWithinPartitions("repo", "kind", "seq", "sha", "change_ix").select(*[c for c in COLUMNS if c in needed or c in ("repo", "kind")]).mapInArrow(run, f"{BLAME}, live boolean")


def blame_history(patches: DataFrame, edges: DataFrame | None, keep: int = 1000, full_blame: Callable[[str, str, str], Blame] | None = None, parts: int | None = None) -> DataFrame:
    """A row (schema ``BLAME``) for each file that each commit changes, with the
    commit that every line comes from; merges show deletions and what differs
    from every parent. ``patches`` has a row without diff for a commit without changes."""
    return fold_history(patches, edges, None, keep, full_blame, (False,), parts).drop("live")


def blame_lines(blame: DataFrame) -> DataFrame:
    """(repo, sha, path, line_no, line, origin_sha), lines counted from 1."""
    one = blame.filter("NOT is_binary").select("repo", "sha", "path", F.posexplode("lines").alias("n", "l"))
    return one.select("repo", "sha", "path", (F.col("n") + 1).alias("line_no"), "l.line", F.col("l.commit").alias("origin_sha"))
