"""The given tables seen as history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import parts_of, read_table

#: events that make a part
EVENTS = 50_000

#: Events as commits: a repository is a user, a branch an event type, ``view`` the default one.
COMMITS_SQL = """
e AS (SELECT CAST(user_id AS VARCHAR) AS repo, CAST(event_id AS VARCHAR) AS sha, event_type AS branch, ts, event_id FROM events),
v AS (SELECT *, lag(sha) OVER (PARTITION BY repo, branch ORDER BY ts, event_id) AS own,
             lag(sha) OVER (PARTITION BY repo ORDER BY ts, event_id) AS prev, lag(branch) OVER (PARTITION BY repo ORDER BY ts, event_id) AS prev_branch,
             max(CASE WHEN branch = 'view' THEN n END) OVER (PARTITION BY repo ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view
      FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) AS n FROM e)),
c AS (SELECT v.repo, v.sha, v.branch, v.ts, v.event_id, coalesce(v.own, CASE WHEN v.branch <> 'view' THEN w.sha END) AS p0,
             CASE WHEN v.branch = 'view' AND v.prev_branch = 'purchase' THEN v.prev END AS p1
      FROM v LEFT JOIN (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) AS n FROM e) AS w ON v.repo = w.repo AND v.last_view = w.n),
edges AS (SELECT repo, sha AS child, p0 AS parent FROM c WHERE p0 IS NOT NULL UNION SELECT repo, sha, p1 FROM c WHERE p1 IS NOT NULL),
refs AS (SELECT repo, branch AS name, max_by(sha, (ts, event_id)) AS sha FROM c GROUP BY repo, branch),
tops AS (SELECT repo, sha FROM refs WHERE name = 'view')"""


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, branch, ts, event_id, p0, p1)"""
    events = read_table(spark, sf_dir, "events")
    e = events.select(F.col("user_id").cast("string").alias("repo"), F.col("event_id").cast("string").alias("sha"), F.col("event_type").alias("branch"), "ts", "event_id").repartition(parts_of(events, EVENTS), "repo")
    repo = Window.partitionBy("repo").orderBy("ts", "event_id")
    branch = Window.partitionBy("repo", "branch").orderBy("ts", "event_id")
    view = F.last(F.when(F.col("branch") == "view", F.col("sha")), ignorenulls=True).over(repo.rowsBetween(Window.unboundedPreceding, -1))
    merged = (F.col("branch") == "view") & (F.lag("branch").over(repo) == "purchase")
    seen = e.withColumn("view", view).withColumn("p1", F.when(merged, F.lag("sha").over(repo))).withColumn("own", F.lag("sha").over(branch))
    return seen.select("repo", "sha", "branch", "ts", "event_id", F.coalesce("own", F.when(F.col("branch") != "view", F.col("view"))).alias("p0"), "p1")


def event_edges(commits: DataFrame) -> DataFrame:
    """Edges, and a row with a null parent for each root."""
    parents = F.array_compact(F.array("p0", "p1"))
    return commits.select("repo", F.col("sha").alias("child"), F.posexplode_outer(parents).alias("parent_ix", "parent"))


def event_refs(commits: DataFrame) -> DataFrame:
    heads = commits.groupBy("repo", F.col("branch").alias("name")).agg(F.max_by("sha", F.struct("ts", "event_id")).alias("sha"))
    return heads.withColumn("is_default", F.col("name") == "view")
