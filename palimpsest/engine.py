"""The engine: commits, code statistics and branches of git repositories as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.logs import Times
from palimpsest.operators import blame, graph, meta, stats
from palimpsest.sources import git
from palimpsest.sources.repos import repo_table
from palimpsest.storage import exists, shared_dir, stash
from palimpsest.streaming import checkpoint


@dataclass
class Options:
    """``path``: a repository, or a folder of them. ``checkpoints``: where the state
    between runs is kept, if anywhere; with ``strict_resume`` it has to be of ``commit_from``.
    ``resume``: each repository goes on after the commit that its state is of, new ones from
    their start. ``limit``: that many commits of each log, 0 for all."""

    path: str
    depth: int = 1
    git: str = "git"
    commit_from: str = ""
    inclusive: bool = True
    all_branches: bool = False
    remote: bool = False
    checkpoints: str = ""
    strict_resume: bool = True
    resume: bool = False
    limit: int = 0
    pull_requests: dict[str, list[str]] = field(default_factory=dict)
    include_default: bool = False
    only_pull_requests: bool = False


class HistoryEngine:
    """Tables of the repositories. What a fold or a log gives is written once for each
    engine and read by all that asks for it; ``times`` has what took how long."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options, self.times = spark, options, Times()
        self._kept: dict[str, DataFrame] = {}
        git.register(spark)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            with self.times.step(name, path=self.options.path):
                self._kept[name] = stash(make(), name)
        return self._kept[name]

    def _starts(self) -> str:
        """What logs begin with: a commit, or JSON of one for each repository that has a state."""
        o = self.options
        if not (o.resume and o.checkpoints and checkpoint.numbers(self.spark, o.checkpoints)):
            return o.commit_from
        return json.dumps({r.repo: r.version for r in checkpoint.versions(self.spark, o.checkpoints).collect()})

    def read(self, name: str, **more: str) -> DataFrame:
        o = self.options
        inclusive = o.inclusive and not o.resume
        given = {"path": o.path, "depth": o.depth, "git": o.git, "commitFrom": self._starts(), "inclusive": inclusive, "allBranches": o.all_branches, "remote": o.remote, "limit": o.limit}
        reader = self.spark.read.format(name)
        for k, v in (given | more).items():
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
        return reader.load()

    def cached(self, name: str) -> DataFrame:
        """``read`` from a copy in the shared folder, by the options and the heads; made if it isn't there."""
        heads = self.read("refs").agg(F.sort_array(F.collect_set("sha"))).first()[0]
        key = hashlib.sha256(repr((name, self.options, heads)).encode()).hexdigest()[:32]
        folder = f"{shared_dir(self.spark)}/palimpsest-cache/{key}"
        if not exists(self.spark, f"{folder}/_SUCCESS"):
            self.read(name).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def commits(self) -> DataFrame:
        return self._once("commits", lambda: self.read("commit_log"))

    def commit_files(self) -> DataFrame:
        return self._once("commit_files", lambda: meta.commit_files(self.read("log_lines")))

    def edges(self) -> DataFrame:
        return self._once("edges", lambda: self.read("commit_graph"))

    def repos(self) -> DataFrame:
        """(repo, dir, is_bare)"""
        return repo_table(self.spark, self.options.path, self.options.depth)

    def roots(self) -> DataFrame:
        """(repo, sha): commits without a parent."""
        return graph.roots(self.edges())

    def blame(self) -> DataFrame:
        """Every changed file's version with its lines' commits; the state goes to
        ``checkpoints``, and comes from there in a run that resumes. Folded once."""
        return self._once("fold", self._fold).filter("NOT live").drop("live")

    def _fold(self) -> DataFrame:
        o, root, program = self.options, self.options.path, self.options.git

        def whole(repo: str, commit: str, path: str) -> blame.Blame:
            lines = git.full_blame(program, os.path.normpath(os.path.join(root, repo)), commit, path)
            return blame.Blame(commit, tuple(x for x, _ in lines), tuple(c for _, c in lines))

        state = None
        if o.checkpoints and (o.commit_from or (o.resume and checkpoint.numbers(self.spark, o.checkpoints))):
            state = checkpoint.read_state(self.spark, o.checkpoints, o.commit_from if o.strict_resume and not o.resume else None)
        found = blame.fold_history(self.read("patch_log"), self.edges(), state, full_blame=whole)
        if o.checkpoints:
            found = stash(found, "fold-state")  # apart from the state it came from
            heads = self.read("refs").filter("is_default").select("repo", F.col("sha").alias("version"))
            checkpoint.write_state(found.filter("live"), o.checkpoints, heads)
        return found

    def code(self) -> DataFrame:
        """The statistics of each file version. A version whose commit, or whose file, the log
        doesn't have is an error."""
        return stats.file_stats(self.blame(), self.commits(), self.commit_files(), strict=not self.options.limit)

    def code_by_commit(self) -> DataFrame:
        """(repo, sha, files): the statistics of each commit's files."""
        code = self.code()
        fields = [c for c in code.columns if c not in ("repo", "sha")]
        return code.groupBy("repo", "sha").agg(F.collect_list(F.struct(*fields)).alias("files"))

    def branches(self) -> DataFrame:
        o = self.options
        if not o.all_branches:
            raise ValueError("branches need all_branches")
        asked = [(r, s) for r, shas in o.pull_requests.items() for s in shas]
        pulls = self.spark.createDataFrame(asked, "repo string, sha string") if asked else None
        return graph.branches(self.edges(), self.read("refs"), pulls, include_default=o.include_default, only_pull_requests=o.only_pull_requests)
