"""What a fold has to do: work by commit, totals, and the largest commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_work(patches: DataFrame) -> DataFrame:
    """(repo, sha, files, bytes, is_merge) of each commit."""
    grouped = patches.groupBy("repo", "sha").agg(F.count("diff").alias("files"), F.coalesce(F.sum(F.octet_length("diff")), F.lit(0)).cast("bigint").alias("bytes"), F.max(F.col("diff_from") != "").alias("is_merge"))
    return grouped.withColumn("is_merge", F.coalesce("is_merge", F.lit(False)))


def totals(work: DataFrame) -> DataFrame:
    """(is_merge, commits, files, bytes)"""
    return work.groupBy("is_merge").agg(F.count("*").alias("commits"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def largest(work: DataFrame, n: int = 10, by: str = "bytes") -> DataFrame:
    """The report of the ``n`` commits with most of ``by``."""
    return work.orderBy(F.desc(by), "repo", "sha").limit(n)


def live_state(fold: DataFrame) -> DataFrame:
    """(repo, commits, files, lines): what a fold (with ``live``) leaves for later commits."""
    live = fold.filter("live")
    return live.groupBy("repo").agg(F.countDistinct("sha").alias("commits"), F.count(F.when(F.col("path") != "", 1)).alias("files"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).cast("bigint").alias("lines"))


def dump(blame: DataFrame) -> DataFrame:
    """(repo, sha, path, text): versions as text for a look, a line and its commit in each
    line, by repository, commit and path."""
    one = F.transform("lines", lambda x: F.concat(F.substring(x.commit, 1, 8), F.lit(" "), F.decode(x.line, "UTF-8")))
    text = F.when(F.col("is_binary"), F.lit("(binary)")).otherwise(F.array_join(one, "\n"))
    return blame.select("repo", "sha", "path", text.alias("text")).orderBy("repo", "sha", "path")
