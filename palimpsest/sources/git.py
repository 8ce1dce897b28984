"""Readers of git repositories as Spark data sources, a partition for each one.

``spark.read.format("patch_log").option("path", "/repos").load()``; formats are
``patch_log``, ``log_lines``, ``commit_log``, ``commit_graph``, ``refs`` and ``tree``. Options:
``path`` (a repository or a folder of them), ``depth``, ``git``, ``commitFrom`` (a commit, or JSON of
commits by repository; the others are read from their start), ``inclusive``,
``allBranches``, ``remote`` (refs of origin), ``limit`` (that many commits from the start of a log) and ``commit`` (of ``tree``).
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest import schemas
from palimpsest.functions.patches import patch_log
from palimpsest.sources.repos import find_repos

NO_ATTRIBUTES = ("-c", "core.attributesFile=", "-c", "diff.renameLimit=10000", "-c", "core.quotePath=off")


class GitError(RuntimeError):
    """git failed, or the folder has no usable head."""


def lines_of(git: str, folder: str, *args: str) -> Iterator[bytes]:
    """Lines that git writes, as it writes them. What it says of errors goes to a file, so
    that it never waits for a reader; it ends when the reader does."""
    with tempfile.TemporaryFile() as said:
        run = subprocess.Popen([git, "-C", folder, *args], stdout=subprocess.PIPE, stderr=said)
        try:
            yield from run.stdout
            if run.wait():
                said.seek(0)
                raise GitError(f"{folder}: git {args[0]}: {said.read().decode(errors='replace').strip()}")
        finally:
            run.kill()
            run.stdout.close()
            run.wait()


def text_of(git: str, folder: str, *args: str) -> str:
    return b"".join(lines_of(git, folder, *args)).decode("utf-8", "replace").strip()


def head_of(git: str, folder: str) -> str:
    """The head's sha, or an empty string in a repository without commits."""
    done = subprocess.run([git, "-C", folder, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True, text=True)
    sha = done.stdout.strip()
    return sha if re.fullmatch("[0-9a-f]{40}", sha) else ""


class _Repo(InputPartition):
    def __init__(self, name: str, folder: str):
        self.name, self.folder = name, folder


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file:")
        self.git = options.get("git", "git")
        self.depth = int(options.get("depth", 1))
        start = options.get("commitfrom", "")
        self.starts = json.loads(start) if start.startswith("{") else None
        self.start = "" if self.starts is not None else start
        self.limit = int(options.get("limit", 0))
        self.inclusive = str(options.get("inclusive", "true")).lower() == "true"
        self.all = str(options.get("allbranches", "false")).lower() == "true"
        self.remote = str(options.get("remote", "false")).lower() == "true"
        self.commit = options.get("commit", "HEAD")

    def partitions(self) -> list[_Repo]:
        """Repositories without commits are left out."""
        return [_Repo(os.path.relpath(d, self.root), d) for d in find_repos(self.root, self.depth) if head_of(self.git, d)]

    def span(self, name: str, folder: str) -> list[str]:
        """What ``git log`` is asked for. Before a first commit there is nothing to leave out."""
        start = self.start if self.starts is None else self.starts.get(name, "")
        if not start:
            return ["--all"] if self.all else []
        known = lambda name: subprocess.run([self.git, "-C", folder, "rev-parse", "-q", "--verify", f"{name}^{{commit}}"], capture_output=True).returncode == 0
        if not known(start):
            raise GitError(f"{folder}: there's no commit {start}")
        if not self.inclusive:
            return [f"{start}..HEAD"]
        return [f"{start}^..HEAD"] if known(f"{start}^") else ["HEAD"]

    def read(self, partition: _Repo | None) -> Iterator[tuple]:
        if partition is not None:
            yield from self.rows(partition.name, partition.folder)

    def rows(self, name: str, folder: str) -> Iterator[tuple]:
        raise NotImplementedError


class PatchReader(_Reader):
    def rows(self, name, folder):
        args = [*NO_ATTRIBUTES, "log", "-p", "-m", "--date-order", "--reverse", "--no-abbrev-commit", "--pretty=short", *self.span(name, folder)]
        seq, last = -1, None
        for record in patch_log(lines_of(self.git, folder, *args)):
            seq += record.sha != last
            if self.limit and seq >= self.limit:
                return
            last = record.sha
            for i, diff in enumerate(record.changes or (None,)):
                yield name, record.sha, seq, record.against, i, diff


class LogLineReader(_Reader):
    def rows(self, name, folder):
        args = [*NO_ATTRIBUTES, "log", "-c", "--raw", "--reverse", "--numstat", "--pretty=format:!%H", *self.span(name, folder)]
        sha, n = "", 0
        for raw in lines_of(self.git, folder, *args):
            line = raw.rstrip(b"\n").decode("utf-8", "replace")
            if line.startswith("!"):
                sha, n = line[1:], n + 1
                if self.limit and n > self.limit:
                    return
            elif line and not line.startswith("::"):  # a merge's combined line
                yield name, sha, line


class CommitReader(_Reader):
    def rows(self, name, folder):
        form = "%x1f".join(("%H", "%an", "%ae", "%cn", "%ce", "%aI", "%P", "%s"))
        for i, raw in enumerate(lines_of(self.git, folder, "log", "--reverse", f"--pretty=format:{form}", *self.span(name, folder))):
            if self.limit and i >= self.limit:
                return
            sha, an, ae, cn, ce, date, parents, subject = raw.rstrip(b"\n").decode("utf-8", "replace").split("\x1f", 7)
            when = datetime.fromisoformat(date)
            yield name, sha, an, ae, cn, ce, when.astimezone(timezone.utc), int(when.utcoffset().total_seconds() // 60), i + 1, subject, parents.split()


class GraphReader(_Reader):
    def rows(self, name, folder):
        span = ["--all"] if self.all else []
        for raw in lines_of(self.git, folder, "log", "--reverse", "--pretty=format:%H@%P", *span):
            sha, _, parents = raw.decode().strip().partition("@")
            for i, parent in enumerate(parents.split() or (None,)):
                yield name, sha, parent, i


class RefReader(_Reader):
    def rows(self, name, folder):
        default = text_of(self.git, folder, "rev-parse", "--abbrev-ref", "HEAD")
        if default == "HEAD":
            raise GitError(f"{folder}: the head is detached")
        place = "refs/remotes/origin" if self.remote else "refs/heads"
        form = "%(refname:short)@@@%(objectname)@@@%(committerdate:iso-strict)"
        seen = False
        for line in text_of(self.git, folder, "for-each-ref", "--sort=refname", f"--format={form}", place).splitlines():
            ref, sha, date = line.split("@@@", 2)
            ref = ref.removeprefix("origin/") if self.remote else ref
            if ref in ("HEAD", "origin") or ref.startswith("(HEAD detached"):
                continue
            when = datetime.fromisoformat(date)
            seen |= ref == default
            yield name, ref, sha, when.astimezone(timezone.utc), int(when.utcoffset().total_seconds() // 60), ref == default
        if not seen:
            yield name, default, head_of(self.git, folder), None, None, True


class TreeReader(_Reader):
    def rows(self, name, folder):
        sha = text_of(self.git, folder, "rev-parse", self.commit)
        for raw in lines_of(self.git, folder, *NO_ATTRIBUTES, "ls-tree", "--name-only", "-r", sha):
            yield name, sha, raw.rstrip(b"\n").decode("utf-8", "replace")


def _source(label: str, fields: str, reader: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

    Source.__name__ = Source.__qualname__ = reader.__name__.replace("Reader", "Source")
    return Source


SOURCES = (
    _source("patch_log", schemas.PATCHES, PatchReader),
    _source("log_lines", "repo string, sha string, line string", LogLineReader),
    _source("commit_log", schemas.COMMITS, CommitReader),
    _source("commit_graph", schemas.EDGES, GraphReader),
    _source("refs", schemas.REFS, RefReader),
    _source("tree", schemas.TREE, TreeReader),
)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)


def full_blame(git: str, folder: str, commit: str, path: str) -> list[tuple[bytes, str]]:
    """(line, commit) of each line, as git itself attributes them."""
    out, sha = [], ""
    for raw in lines_of(git, folder, "blame", "--porcelain", commit, "--", path):
        line = raw[:-1] if raw.endswith(b"\n") else raw
        if line.startswith(b"\t"):
            out.append((line[1:-1] if line.endswith(b"\r") else line[1:], sha))
        elif re.match(rb"[0-9a-f]{40} \d+ \d+", line):
            sha = line[:40].decode()
    return out
