"""Commit graphs: reachability, branches, branch points, merge commits.

A repository's graph is one row with arrays, so that a partition walks many
repositories without starting a group for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.schemas import BRANCHES

Parents = dict[str, list[str]]


class UnknownCommit(ValueError):
    """A commit that the graph doesn't have."""


def descend(parents: Parents, head: str, stop: Iterable[str] = ()) -> set[str]:
    """``head`` and its ancestors; a commit in ``stop`` is taken but not passed."""
    stop = set(stop)
    found, todo = {head}, [head]
    while todo:
        at = todo.pop()
        if at in stop:
            continue
        for p in parents.get(at, ()):
            if p not in found:
                found.add(p)
                todo.append(p)
    return found


def history(parents: Parents, head: str, barred: Container[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Commits in depth-first order, last parents first, turned round, and the
    barred parents met on the way."""
    order, met, seen, todo = [], [], set(), [head]
    while todo:
        at = todo.pop()
        if at in barred and at != head:
            met.append(at)
            continue
        if at in seen:
            continue
        if at not in parents:
            raise UnknownCommit(at)
        seen.add(at)
        order.append(at)
        todo += parents[at]  # the last one is taken first
    return order[::-1], met


def earliest(parents: Parents, points: Iterable[str]) -> list[str]:
    """The points without another point among their ancestors, sorted."""
    points = set(points)
    if len(points) < 2:
        return list(points)
    return sorted(p for p in points if not (descend(parents, p) - {p}) & points)


class Default:
    """A default branch: its commits, their children, and its chain of first parents."""

    def __init__(self, parents: Parents, head: str):
        self.parents, self.head, self.commits = parents, head, descend(parents, head)
        self.children: Parents = {}
        for child, ps in parents.items():
            for p in ps:
                self.children.setdefault(p, []).append(child)
        self.chain, at = {}, head
        while at not in self.chain:
            self.chain[at] = None
            at = next(iter(parents.get(at, ())), at)

    def without(self, head: str) -> Container[str]:
        """The commits that it would have if ``head`` had no parents."""
        return descend(self.parents, self.head, {head}) if head in self.chain else Without(self, head)


class Without:
    """Whether a commit is reached without passing a merged head that isn't on the chain of first
    parents. All of the chain is; others are if a way up that avoids the head leads to it, so
    that only what lies about the branch is walked."""

    def __init__(self, default: Default, head: str):
        self.default, self.head, self.known = default, head, {head: True}

    def __contains__(self, commit: str) -> bool:
        chain, commits, known = self.default.chain, self.default.commits, self.known
        if commit in chain:
            return True
        if commit not in known:
            seen, todo, found = {commit}, [commit], False
            while todo and not found:
                for child in self.default.children.get(todo.pop(), ()):
                    if child == self.head or child in seen or child not in commits:
                        continue
                    found = child in chain or known.get(child, False)
                    if found:
                        break
                    if child not in known:
                        seen.add(child)
                        todo.append(child)
            known |= {commit: True} if found else dict.fromkeys(seen, False)
        return known[commit]


def branch_commits(default: Default, head: str) -> tuple[list[str], list[str]]:
    """The branch's own commits, oldest first, and where it left the default branch; of a
    merged one, where it would have without the merge."""
    commits, met = history(default.parents, head, default.without(head) if head in default.commits else default.commits)
    return commits, earliest(default.parents, met)


def behind(parents: Parents, default_head: str, on_default: set[str], head: str) -> int:
    """Commits from the default head down to those that the branch reaches first."""
    shared = descend(parents, head, on_default)
    return len(descend(parents, default_head, shared) - shared)


def merge_commit(children: Parents, on_default: set[str], head: str) -> str:
    return min((c for c in children.get(head, ()) if c in on_default), default="")


def last_common_parent(parents: Parents, heads: list[str]) -> str:
    """The first commit that walks by level from all heads meet at, else ""."""
    reached: dict[str, set[int]] = {}
    level = [(h, i) for i, h in enumerate(heads)]
    while level:
        following = []
        for at, i in level:
            by = reached.setdefault(at, set())
            if i in by:
                continue
            by.add(i)
            if len(by) == len(heads):
                return at
            following += [(p, i) for p in parents.get(at, ())]
        level = following
    return ""


def branch_id(name: str, points: list[str]) -> str:
    return hashlib.sha256((name + (points[0] if points else "")).encode()).hexdigest()


def repo_branches(repo: str, parents: Parents, refs: list[dict], pull_requests: Iterable[str] = (), include_default: bool = False, only_pull_requests: bool = False) -> Iterator[dict]:
    """One record for each branch, and for each pull request that the graph has."""
    default = next((r for r in refs if r["is_default"]), None)
    if default is None:
        return
    top = default["sha"]
    if top not in parents:
        raise UnknownCommit(top)
    branch = Default(parents, top)
    on_default, children = branch.commits, branch.children

    def record(name: str, head: str) -> dict:
        commits, points = branch_commits(branch, head)
        merged = head in on_default
        return {
            "repo": repo, "branch_id": branch_id(name, points) if name else "", "name": name, "is_pull_request": not name, "head_sha": head, "is_default": False, "is_merged": merged,
            "merge_commit": merge_commit(children, on_default, head) if merged else "", "branched_from_commits": points, "commits": commits,
            "behind_default_count": behind(parents, top, on_default, head) if points and not merged else 0, "ahead_default_count": len(commits), "first_commit": commits[0],
        }

    if include_default and not only_pull_requests:
        commits, _ = history(parents, top)
        yield record("-", top) | {
            "branch_id": hashlib.sha256(default["name"].encode()).hexdigest(), "name": default["name"], "is_default": True, "is_merged": False, "merge_commit": "",
            "branched_from_commits": [], "commits": commits, "behind_default_count": 0, "ahead_default_count": 0, "first_commit": commits[0],
        }
    if not only_pull_requests:
        yield from (record(r["name"], r["sha"]) for r in sorted(refs, key=lambda r: r["name"]) if not r["is_default"])
    yield from (record("", sha) for sha in sorted(set(pull_requests)) if sha in parents)


def graphs(edges: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(repo, graph array<struct<child, parents>>). Roots come as edges with a
    null parent, or from ``commits`` (repo, sha)."""
    rows = edges.select("repo", "child", F.when(F.col("parent").isNotNull(), F.struct("parent_ix", "parent")).alias("p"))
    if commits is not None:
        rows = rows.unionByName(commits.select("repo", F.col("sha").alias("child"), F.lit(None).cast("struct<parent_ix:int,parent:string>").alias("p")))
    one = rows.groupBy("repo", "child").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    one = one.select("repo", F.struct("child", F.col("ps.parent").alias("parents")).alias("node"))
    return one.groupBy("repo").agg(F.collect_list("node").alias("graph"))


#: commits or rows that a Python worker holds at once, and those of one repository besides
HELD = 20_000


def graph_rows(batches) -> Iterator[dict]:
    """Rows with a column ``graph``, which becomes a map from commit to parents, a few at a time: a
    batch may have thousands of graphs, and as Python objects they take many times its size."""
    for b in batches:
        sizes = b.column("graph").value_lengths().fill_null(0).to_pylist()
        at = 0
        while at < len(sizes):
            end, n = at + 1, sizes[at]
            while end < len(sizes) and n + sizes[end] <= HELD and end - at < HELD // 10:
                n += sizes[end]
                end += 1
            some = b.slice(at, end - at)
            children, parents = some.column("graph").flatten().flatten()
            child = children.to_numpy(zero_copy_only=False).tolist()
            parent = parents.flatten().to_numpy(zero_copy_only=False).tolist()
            counts = parents.value_lengths().fill_null(0).to_pylist()
            node = edge = 0
            for size, row in zip(sizes[at:end], some.drop_columns(["graph"]).to_pylist()):
                graph = {}
                for i in range(node, node + size):
                    graph[child[i]] = parent[edge : edge + counts[i]]
                    edge += counts[i]
                node += size
                yield row | {"graph": graph}
            at = end


def commit_batches(rows: Iterable[tuple[str, Iterable[str]]]) -> Iterator[pa.RecordBatch]:
    """(repo, sha) of repositories with their commits, in batches of bounded size."""
    repo, sha = [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(repo, pa.string()), pa.array(sha, pa.string())], ["repo", "sha"])

    for name, commits in rows:
        sha += commits
        repo += [name] * (len(sha) - len(repo))
        if len(sha) > HELD:
            yield batch()
            repo, sha = [], []
    if sha:
        yield batch()


def branches(edges: DataFrame, refs: DataFrame, pull_requests: DataFrame | None = None, commits: DataFrame | None = None, include_default: bool = False, only_pull_requests: bool = False) -> DataFrame:
    """A row for each branch of each repository (schema ``BRANCHES``).

    One shuffle by repository brings graph and refs together.
    """
    heads = refs.groupBy("repo").agg(F.collect_list(F.struct("name", "sha", "is_default")).alias("refs"))
    joined = graphs(edges, commits).join(heads, "repo")
    if pull_requests is not None:
        asked = pull_requests.groupBy("repo").agg(F.collect_set("sha").alias("prs"))
        joined = joined.join(asked, "repo", "left")
    else:
        joined = joined.withColumn("prs", F.lit(None).cast("array<string>"))
    names = [c.split()[0] for c in BRANCHES.split(", ")]

    ints, arrays = {"behind_default_count", "ahead_default_count"}, {"commits", "branched_from_commits"}
    kinds = {n: pa.int32() if n in ints else pa.list_(pa.string()) if n in arrays else pa.bool_() if n.startswith("is_") else pa.string() for n in names}

    def run(batches):
        rows, held = [], 0
        for r in graph_rows(batches):
            for found in repo_branches(r["repo"], r["graph"], r["refs"], r["prs"] or (), include_default, only_pull_requests):
                rows.append(found)
                held += 5 + len(found["commits"])
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds[n]) for n in names], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds[n]) for n in names], names)

    return joined.select("repo", "graph", "refs", "prs").mapInArrow(run, BRANCHES)


def all_reached(parents: Parents, heads: Iterable[str]) -> set[str]:
    found: set[str] = set()
    for h in heads:
        if h not in found:
            found |= descend(parents, h, found)
    return found


def reachable(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, sha): the heads (repo, sha) and their ancestors, by repository."""
    starts = heads.groupBy("repo").agg(F.collect_set("sha").alias("heads"))

    def run(batches):
        yield from commit_batches((r["repo"], sorted(all_reached(r["graph"], r["heads"]))) for r in graph_rows(batches))

    return starts.join(graphs(edges), "repo", "left").select("repo", "graph", "heads").mapInArrow(run, "repo string, sha string")


def roots(edges: DataFrame) -> DataFrame:
    """(repo, sha): the commits that have no parent."""
    return edges.groupBy("repo", F.col("child").alias("sha")).agg(F.count("parent").alias("n")).filter("n = 0").select("repo", "sha")


def commit_range(edges: DataFrame, heads: DataFrame, start: DataFrame | None, inclusive: bool = True) -> DataFrame:
    """Commits reachable from ``heads`` but not from ``start`` (repo, sha), with
    ``start`` itself if ``inclusive``."""
    if start is None:
        return reachable(edges, heads)
    ends = [x.groupBy("repo").agg(F.collect_set("sha").alias(c)) for x, c in ((heads, "heads"), (start, "start"))]

    def run(batches):
        def rest(r):
            graph, start = r["graph"], r["start"] or ()
            before = [p for s in start for p in graph.get(s, ())] if inclusive else start
            return sorted(all_reached(graph, r["heads"]) - all_reached(graph, before))

        yield from commit_batches((r["repo"], rest(r)) for r in graph_rows(batches))

    joined = ends[0].join(ends[1], "repo", "left").join(graphs(edges), "repo", "left")
    return joined.select("repo", "graph", "heads", "start").mapInArrow(run, "repo string, sha string")


def common_parents(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, sha): the first commit that walks by level from all heads (repo, sha) of a
    repository meet at; repositories whose heads have none in common are left out."""
    asked = heads.groupBy("repo").agg(F.sort_array(F.collect_set("sha")).alias("heads"))

    def run(batches):
        met = ((r["repo"], last_common_parent(r["graph"], r["heads"])) for r in graph_rows(batches))
        yield from commit_batches((repo, [sha]) for repo, sha in met if sha)

    return graphs(edges).join(asked, "repo").select("repo", "graph", "heads").mapInArrow(run, "repo string, sha string")


def children(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, sha, children): each commit's children, sorted; none is an empty list."""
    grouped = edges.filter("parent IS NOT NULL").groupBy("repo", F.col("parent").alias("sha")).agg(F.sort_array(F.collect_set("child")).alias("children"))
    empty = F.array().cast("array<string>")
    return commits.select("repo", "sha").join(grouped, ["repo", "sha"], "left").withColumn("children", F.coalesce("children", empty))
