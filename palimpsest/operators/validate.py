"""The fold's lines against those that git itself attributes."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.blame import blame_lines
from palimpsest.sources import git

SHORT = 10


def differences(engine) -> DataFrame:
    """(repo, sha, path, line_no, line, origin_sha, git_line, git_sha) of lines that differ. Other
    owners of equal lines are let pass if the line is short or only returns: git may choose another copy."""
    shown = engine.blame().filter("NOT is_binary AND size(lines) > 0")
    root, program = engine.options.path, engine.options.git

    def run(batches):
        for b in batches:
            repo, sha, path, no, line, origin = [], [], [], [], [], []
            for r in b.to_pylist():
                for i, (text, commit) in enumerate(git.full_blame(program, os.path.normpath(os.path.join(root, r["repo"])), r["sha"], r["path"])):
                    for values, v in zip((repo, sha, path, no, line, origin), (r["repo"], r["sha"], r["path"], i + 1, text, commit)):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(repo, pa.string()), pa.array(sha, pa.string()), pa.array(path, pa.string()), pa.array(no, pa.int32()), pa.array(line, pa.binary()), pa.array(origin, pa.string())], ["repo", "sha", "path", "line_no", "git_line", "git_sha"])

    theirs = shown.select("repo", "sha", "path").mapInArrow(run, "repo string, sha string, path string, line_no int, git_line binary, git_sha string")
    both = blame_lines(shown).join(theirs, ["repo", "sha", "path", "line_no"], "full")
    text = F.trim(F.col("line").cast("string"))
    same = text.eqNullSafe(F.trim(F.col("git_line").cast("string")))
    passed = same & (F.col("origin_sha").eqNullSafe(F.col("git_sha")) | (F.length(text) <= SHORT) | (text == "return"))
    return both.filter(~passed)
