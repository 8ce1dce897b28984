"""Queries on commit graphs, over events as commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.plans.adapters import COMMITS_SQL, event_commits, event_edges, event_refs


def branch_records(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    commits = event_commits(spark, sf_dir)
    return graph.branches(event_edges(commits), event_refs(commits), **options)


def branch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = branch_records(spark, sf_dir)
    points = F.array_join("branched_from_commits", ",").alias("branched_from")
    counts = [F.col(f"{x}_default_count").cast("bigint").alias(x) for x in ("ahead", "behind")]
    return b.select("repo", "name", "branch_id", "head_sha", "is_merged", "merge_commit", points, *counts, F.array_join(F.sort_array("commits"), ",").alias("commits"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's purchases as pull requests, and one that doesn't exist."""
    commits = event_commits(spark, sf_dir)
    asked = commits.filter("branch = 'purchase'").select("repo", "sha")
    asked = asked.unionByName(commits.select("repo", F.lit("none").alias("sha")).distinct())
    b = graph.branches(event_edges(commits), event_refs(commits), asked, only_pull_requests=True)
    return b.select("repo", "head_sha", "is_pull_request", "is_merged", "merge_commit", F.col("ahead_default_count").cast("bigint").alias("ahead"))


def default_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each default branch's commits in order."""
    b = branch_records(spark, sf_dir, include_default=True).filter("is_default")
    return b.select("repo", "name", "branch_id", "head_sha", F.posexplode("commits").alias("pos", "sha")).withColumn("pos", F.col("pos").cast("bigint"))


def reachable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = event_commits(spark, sf_dir)
    return graph.reachable(event_edges(commits), event_refs(commits).filter("is_default").select("repo", "sha"))


def commits_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each repository's first merge on, that commit included."""
    commits = event_commits(spark, sf_dir)
    start = commits.filter("p1 IS NOT NULL").groupBy("repo").agg(F.min_by("sha", F.struct("ts", "event_id")).alias("sha"))
    return graph.commit_range(event_edges(commits), event_refs(commits).filter("is_default").select("repo", "sha"), start)


def commit_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = event_commits(spark, sf_dir)
    out = graph.children(event_edges(commits), commits)
    return out.select("repo", "sha", F.array_join("children", ",").alias("children"), F.size("children").cast("bigint").alias("n_children"))


def commit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("repo").orderBy("ts", "event_id")
    return event_commits(spark, sf_dir).select("repo", "sha", F.row_number().over(order).cast("bigint").alias("ordinal"))


def last_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each commit's state may go: after its last child, by ordinal."""
    commits = event_commits(spark, sf_dir)
    order = commit_ordinals(spark, sf_dir)
    edges = event_edges(commits).filter("parent IS NOT NULL")
    child = order.select("repo", F.col("sha").alias("child"), F.col("ordinal").alias("at"))
    used = edges.join(child, ["repo", "child"]).groupBy("repo", F.col("parent").alias("sha")).agg(F.max("at").alias("last_use"), F.count("*").alias("uses"))
    return order.join(used, ["repo", "sha"], "left").select("repo", "sha", "ordinal", "last_use", F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"))


QUERIES = {f.__name__: f for f in (branch_summary, pull_requests, default_history, reachable_commits, commits_after, commit_children, commit_ordinals, last_uses)}

_REACH = """
r(repo, sha) AS (SELECT repo, sha FROM tops UNION SELECT r.repo, e.parent FROM r JOIN edges e ON e.repo = r.repo AND e.child = r.sha)"""

_WALKS = f"""{COMMITS_SQL}, {_REACH},
b AS (SELECT refs.repo, refs.name, refs.sha AS head, tops.sha AS top, EXISTS (SELECT 1 FROM r WHERE r.repo = refs.repo AND r.sha = refs.sha) AS is_merged
      FROM HEADS AS refs JOIN tops ON tops.repo = refs.repo),
-- what the default branch has without a merged branch: the walk stops at its head
w(repo, name, head, sha) AS (
  SELECT repo, name, head, top FROM b WHERE is_merged
  UNION SELECT w.repo, w.name, w.head, e.parent FROM w JOIN edges e ON e.repo = w.repo AND e.child = w.sha WHERE w.sha <> w.head),
bar AS (SELECT repo, name, head, sha FROM w UNION ALL SELECT b.repo, b.name, b.head, r.sha FROM b JOIN r ON r.repo = b.repo WHERE NOT is_merged),
own(repo, name, head, sha) AS (
  SELECT repo, name, head, head FROM b
  UNION SELECT o.repo, o.name, o.head, e.parent FROM own o JOIN edges e ON e.repo = o.repo AND e.child = o.sha
        WHERE NOT EXISTS (SELECT 1 FROM bar x WHERE x.repo = o.repo AND x.name = o.name AND x.head = o.head AND x.sha = e.parent)),
points AS (SELECT DISTINCT o.repo, o.name, o.head, e.parent AS sha FROM own o JOIN edges e ON e.repo = o.repo AND e.child = o.sha
           JOIN bar x ON x.repo = o.repo AND x.name = o.name AND x.head = o.head AND x.sha = e.parent),
above(repo, name, head, point, sha) AS (
  SELECT p.repo, p.name, p.head, p.sha, e.parent FROM points p JOIN edges e ON e.repo = p.repo AND e.child = p.sha
  UNION SELECT a.repo, a.name, a.head, a.point, e.parent FROM above a JOIN edges e ON e.repo = a.repo AND e.child = a.sha),
kept AS (SELECT p.* FROM points p WHERE NOT EXISTS (
  SELECT 1 FROM above a JOIN points q ON q.repo = a.repo AND q.name = a.name AND q.head = a.head AND q.sha = a.sha
  WHERE a.repo = p.repo AND a.name = p.name AND a.head = p.head AND a.point = p.sha)),
m AS (SELECT b.repo, b.name, b.head, min(e.child) AS sha FROM b JOIN edges e ON e.repo = b.repo AND e.parent = b.head
      JOIN r ON r.repo = e.repo AND r.sha = e.child WHERE is_merged GROUP BY ALL)"""

_SUMMARY = f"""WITH RECURSIVE {_WALKS.replace("HEADS", "(SELECT * FROM refs WHERE name <> 'view')")},
sh(repo, name, sha) AS (
  SELECT repo, name, head FROM b WHERE NOT is_merged
  UNION SELECT s.repo, s.name, e.parent FROM sh s JOIN edges e ON e.repo = s.repo AND e.child = s.sha
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.repo = s.repo AND r.sha = s.sha)),
bh(repo, name, sha) AS (
  SELECT b.repo, b.name, b.top FROM b WHERE NOT is_merged AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.repo = b.repo AND sh.name = b.name AND sh.sha = b.top)
  UNION SELECT h.repo, h.name, e.parent FROM bh h JOIN edges e ON e.repo = h.repo AND e.child = h.sha
        WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.repo = h.repo AND sh.name = h.name AND sh.sha = e.parent)),
f AS (SELECT repo, name, string_agg(sha, ',' ORDER BY sha) AS branched_from, min(sha) AS first FROM kept GROUP BY ALL),
oc AS (SELECT repo, name, string_agg(sha, ',' ORDER BY sha) AS commits, count(*) AS ahead FROM own GROUP BY ALL),
n AS (SELECT repo, name, count(*) AS behind FROM bh GROUP BY ALL)
SELECT b.repo, b.name, sha256(b.name || coalesce(f.first, '')) AS branch_id, b.head AS head_sha, is_merged, coalesce(m.sha, '') AS merge_commit,
       coalesce(f.branched_from, '') AS branched_from, oc.ahead, CASE WHEN f.first IS NULL THEN 0 ELSE coalesce(n.behind, 0) END AS behind, oc.commits
FROM b JOIN oc USING (repo, name) LEFT JOIN f USING (repo, name) LEFT JOIN n USING (repo, name) LEFT JOIN m ON m.repo = b.repo AND m.name = b.name"""

_PULLS = f"""WITH RECURSIVE {_WALKS.replace("HEADS", "(SELECT DISTINCT repo, '' AS name, sha FROM c WHERE branch = 'purchase')")}
SELECT b.repo, b.head AS head_sha, true AS is_pull_request, b.is_merged, coalesce(any_value(m.sha), '') AS merge_commit, count(DISTINCT own.sha) AS ahead
FROM b JOIN own ON own.repo = b.repo AND own.head = b.head LEFT JOIN m ON m.repo = b.repo AND m.head = b.head GROUP BY b.repo, b.head, b.is_merged"""

_ORDINALS = f"WITH {COMMITS_SQL} SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) AS ordinal FROM c"

ORACLES = {
    # the walk of one branch as a list of what is to do and one of what is done, a row for each step
    "default_history": f"""WITH RECURSIVE {COMMITS_SQL}, pa AS (SELECT repo, sha, list_filter([p0, p1], lambda x: x IS NOT NULL) AS ps FROM c),
k(repo, head, todo, done) AS (
  SELECT repo, sha, [sha], []::VARCHAR[] FROM tops
  UNION ALL SELECT k.repo, k.head, CASE WHEN list_contains(k.done, pa.sha) THEN k.todo[:-2] ELSE list_concat(k.todo[:-2], pa.ps) END,
    CASE WHEN list_contains(k.done, pa.sha) THEN k.done ELSE list_append(k.done, pa.sha) END
  FROM k JOIN pa ON pa.repo = k.repo AND pa.sha = k.todo[-1] WHERE len(k.todo) > 0),
f AS (SELECT repo, head, done, unnest(range(1, len(done) + 1)) AS i FROM k WHERE len(todo) = 0)
SELECT repo, 'view' AS name, sha256('view') AS branch_id, head AS head_sha, len(done) - i AS pos, done[i] AS sha FROM f""",
    "branch_summary": _SUMMARY,
    "pull_requests": _PULLS,
    "reachable_commits": f"WITH RECURSIVE {COMMITS_SQL}, {_REACH} SELECT repo, sha FROM r",
    "commits_after": f"""WITH RECURSIVE {COMMITS_SQL}, {_REACH},
s(repo, sha) AS (SELECT e.repo, e.parent FROM (SELECT repo, min_by(sha, (ts, event_id)) AS sha FROM c WHERE p1 IS NOT NULL GROUP BY repo) f JOIN edges e ON e.repo = f.repo AND e.child = f.sha
     UNION SELECT s.repo, e.parent FROM s JOIN edges e ON e.repo = s.repo AND e.child = s.sha)
SELECT r.repo, r.sha FROM r ANTI JOIN s ON s.repo = r.repo AND s.sha = r.sha""",
    "commit_children": f"""WITH {COMMITS_SQL}, k AS (SELECT repo, parent AS sha, string_agg(child, ',' ORDER BY child) AS children, count(*) AS n FROM edges GROUP BY ALL)
SELECT c.repo, c.sha, coalesce(children, '') AS children, coalesce(n, 0) AS n_children FROM c LEFT JOIN k USING (repo, sha)""",
    "commit_ordinals": _ORDINALS,
    "last_uses": f"""WITH {COMMITS_SQL}, o AS (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) AS ordinal FROM c),
u AS (SELECT e.repo, e.parent AS sha, max(o.ordinal) AS last_use, count(*) AS uses FROM edges e JOIN o ON o.repo = e.repo AND o.sha = e.child GROUP BY ALL)
SELECT o.repo, o.sha, o.ordinal, u.last_use, coalesce(u.uses, 0) AS uses FROM o LEFT JOIN u USING (repo, sha)""",
}
