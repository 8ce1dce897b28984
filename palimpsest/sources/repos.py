"""Repositories below a folder, as a table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def find_repos(folder: str, depth: int = 1) -> Iterator[str]:
    """Working copies (with a ``.git`` folder, not searched further) and bare
    repositories (named ``*.git``, with ``objects``), down to ``depth`` folders below."""
    if os.path.isdir(os.path.join(folder, ".git")):
        yield folder
        return
    if folder.endswith(".git") and os.path.isdir(os.path.join(folder, "objects")):
        yield folder
    if depth:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.is_dir():
                yield from find_repos(entry.path, depth - 1)


def repo_table(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """(repo, dir, is_bare)"""
    found = [(os.path.relpath(d, folder), d, not os.path.isdir(os.path.join(d, ".git"))) for d in find_repos(folder, depth)]
    return spark.createDataFrame(found, "repo string, dir string, is_bare boolean")


def each_repo(folder: str, run: Callable[[str], None], depth: int = 1) -> list[tuple[str, Exception]]:
    """Call ``run`` for every repository; those that fail, with their errors."""
    failed = []
    for repo in find_repos(folder, depth):
        try:
            run(repo)
        except Exception as error:  # noqa: BLE001 - reported with the repository
            failed.append((repo, error))
    return failed
