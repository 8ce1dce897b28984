"""Commits and their files from the lines of a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.log_text import numstat_path, raw_files

RAW = ("filename", "status", "renamed", "copied", "renamed_from", "renamed_to", "copied_from")


def commit_files(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Files (schema ``COMMIT_FILES``) from (repo, sha, line), lines in any order:
    raw lines say what became of a file, numstat lines how many lines changed.

    A file that only a numstat line names is modified; a later line wins over an
    earlier one only in counts. One shuffle of the lines by commit (into ``parts`` parts if given)
    brings both together: they are shorter than what they say.
    """
    apart = lines.filter("line <> ''")
    apart = apart.repartition(parts, "sha") if parts else apart.repartition("sha")  # a constant repo would be folded away
    number = lambda i: F.expr(f"try_cast(get(p, {i}) AS int)")
    binary = F.get("p", F.lit(0)) == "-"
    counts = [F.when(binary, 0).otherwise(F.coalesce(number(i), F.lit(0))).alias(n) for i, n in enumerate(("additions", "deletions"))]
    kinds = {"filename": "string", "status": "string", "renamed": "boolean", "copied": "boolean", "renamed_from": "string", "renamed_to": "string", "copied_from": "string"}
    none = {"additions": "int", "deletions": "int", "binary": "boolean"}
    of_raw = lambda f: F.struct(F.lit(True).alias("told"), *[f[c].alias(c) for c in RAW], *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    of_stat = F.struct(F.lit(False).alias("told"), numstat_path(F.get("p", F.lit(2))).alias("filename"), *[F.lit(None).cast(t).alias(c) for c, t in list(kinds.items())[1:]], *counts, binary.alias("binary"))
    found = F.when(F.col("line").startswith(":"), F.transform(raw_files(F.col("line")), of_raw)).when(F.size("p") == 3, F.array(of_stat))
    one = apart.withColumn("p", F.split("line", "\t")).select("repo", "sha", F.explode(found).alias("f")).select("repo", "sha", "f.*")
    keys = ["repo", "sha", "filename"]
    first = lambda c: F.max(F.when(F.col("told"), F.col(c))).alias(c)
    out = one.groupBy("sha", "filename", "repo").agg(*[first(c) for c in RAW[1:]], *[F.max(F.when(~F.col("told"), F.col(c))).alias(c) for c in ("additions", "deletions", "binary")])
    filled = {"status": F.lit("modified"), "renamed": F.lit(False), "copied": F.lit(False), "additions": F.lit(0), "deletions": F.lit(0), "binary": F.lit(False)}
    return out.select(*keys, *[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in (*RAW[1:], "additions", "deletions", "binary")])


def files_by_commit(commits: DataFrame, files: DataFrame) -> DataFrame:
    """``commits`` with ``files``, a map from name to file."""
    fields = [c for c in files.columns if c not in ("repo", "sha")]
    grouped = files.groupBy("repo", "sha").agg(F.map_from_entries(F.collect_list(F.struct("filename", F.struct(*fields)))).alias("files"))
    return commits.join(grouped, ["repo", "sha"], "left")
