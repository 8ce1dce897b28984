"""What a task or a worker holds, and how often work is done, doesn't grow with the input."""

import re
from datetime import datetime

import pyarrow as pa

from palimpsest.operators import blame, graph, meta, stats
from palimpsest.plans import history, merges

SF = "/root/testdata/sf0.001"
GRAPH = pa.list_(pa.struct([("child", pa.string()), ("parents", pa.list_(pa.string()))]))


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_graphs_become_objects_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(graph, "HELD", 100)
    graphs = [[{"child": f"{i}-{k}", "parents": [f"{i}-{p}" for p in range(max(0, k - 2), k)]} for k in range(i % 40)] for i in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(graphs, GRAPH), pa.array(range(301))], ["graph", "n"]).slice(1)
    want = [{"n": i, "graph": {x["child"]: x["parents"] for x in g or ()}} for i, g in enumerate(graphs)][1:]
    assert list(graph.graph_rows([batch])) == want
    out = list(graph.commit_batches((str(r["n"]), sorted(r["graph"])) for r in graph.graph_rows([batch])))
    assert max(b.num_rows for b in out) < 100 + 40 and sum(b.num_rows for b in out) == sum(len(g or ()) for g in graphs)


def test_branches_in_small_batches(spark):
    edges = spark.createDataFrame([(f"r{i}", f"{i}-{k}", f"{i}-{k - 1}" if k else None, 0) for i in range(30) for k in range(9)], "repo string, child string, parent string, parent_ix int")
    refs = spark.createDataFrame([(f"r{i}", name, f"{i}-{at}", name == "m") for i in range(30) for name, at in (("m", 6), ("b", 8))], "repo string, name string, sha string, is_default boolean")
    rows = graph.branches(edges, refs, include_default=True).collect()
    assert len(rows) == 60 and all(len(r.commits) == (7 if r.is_default else 2) for r in rows)
    start = spark.createDataFrame([(f"r{i}", f"{i}-4") for i in range(0, 30, 2)], "repo string, sha string")
    heads = refs.filter("is_default").select("repo", "sha")
    assert graph.commit_range(edges, heads, start).count() == 15 * 3 + 15 * 7
    assert graph.commit_range(edges, heads, start, inclusive=False).count() == 15 * 2 + 15 * 7


def test_a_range_is_one_walk(spark):
    edges = spark.createDataFrame([("r", "a", None, 0), ("r", "b", "a", 0)], "repo string, child string, parent string, parent_ix int")
    heads = spark.createDataFrame([("r", "b")], "repo string, sha string")
    plan = graph.commit_range(edges, heads, heads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_patches_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([("r", "c", 0, "", 0, b"")], "repo string, sha string, seq bigint, diff_from string, change_ix int, diff binary").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("r", "c", None, 0)], "repo string, child string, parent string, parent_ix int").write.parquet(f"{tmp_path}/e")
    assert exchanges(blame.blame_history(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/e"))) == 1


def test_parents_keep_their_order_and_uses_their_number():
    g = blame.Graph()
    for ix, p in ((1, "b"), (0, "z"), (1, "b"), (None, "q")):
        g.add("m", ix, p)
    assert g.parents("m") == ["q", "z", "b"] and g.uses == {"b": 2, "z": 1, "q": 1} and g.parents("z") == []
    g.expect("m")
    g.expect("m")
    assert g.later == {"b": 2, "z": 1, "q": 1}


def test_the_first_fold_runs_once(spark):
    plan = history.resumed_ledger(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the second fold; what the first gave was written


def test_only_what_is_asked_for_leaves_the_fold(spark):
    commits = history.order_commits(spark, SF)
    patches, edges = history.order_patches(commits), history.order_edges(commits)
    live = blame.fold_history(patches, edges, keep=0, rows=(True,))
    assert live.filter("NOT live").count() == 0 and live.count() == blame.fold_history(patches, edges).filter("live").count() > 0
    # the last version of each ledger is all that lives, and lines by author need no join with all versions
    assert history.lines_by_author(spark, SF)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1


def test_histories_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(merges, "CUSTOMERS", 10)
    assert merges._customers(spark, SF).rdd.getNumPartitions() >= 15
    assert exchanges(merges.root_commits(spark, SF)) == 1


def test_files_of_a_log_are_shuffled_as_lines(spark, tmp_path):
    spark.createDataFrame([("r", "c", "1\t2\tf")], "repo string, sha string, line string").write.parquet(f"{tmp_path}/l")
    found = meta.commit_files(spark.read.parquet(f"{tmp_path}/l"))
    grouped = meta.files_by_commit(spark.createDataFrame([("r", "c")], "repo string, sha string"), found)
    assert exchanges(found) == 1 and grouped.first().files["f"].additions == 1
    # shuffled before they are parsed, and not again
    assert exchanges(history.item_files(spark, SF)) == 1 and exchanges(history.checked_commits(spark, SF)) == 2


def test_a_fold_needs_no_rows_for_edges(spark):
    """Patches that tell their parents give what edges beside them give, with one sort for the orders' windows."""
    commits = history.order_commits(spark, SF)
    for keep, rows in ((0, (True,)), (1000, (False, True))):
        told = blame.fold_history(history.order_patches(commits), None, keep=keep, rows=rows, parts=3)
        beside = blame.fold_history(history.order_patches(commits), history.order_edges(commits), keep=keep, rows=rows)
        assert sorted(map(repr, told.collect())) == sorted(map(repr, beside.collect()))
    plan = history.live_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Scan parquet") == 1


def test_merges_fold_by_told_parents(spark):
    patches, edges = merges.merge_patches(spark, SF), merges.merge_edges(spark, SF)
    for keep in (0, 1000):
        told, beside = (blame.fold_history(patches, e, keep=keep, rows=(False, True)) for e in (None, edges))
        assert sorted(map(repr, told.collect())) == sorted(map(repr, beside.collect()))


def test_a_resumed_fold_by_told_parents(spark):
    commits = history.order_commits(spark, SF)
    patches, edges = history.order_patches(commits), history.order_edges(commits)
    state = blame.fold_history(patches.filter("seq <= 7"), edges).filter("live")
    told, beside = (blame.fold_history(patches.filter("seq > 7"), e, state, keep=0) for e in (None, edges))
    assert sorted(map(repr, told.collect())) == sorted(map(repr, beside.collect()))


def test_patches_are_written_once_in_the_plan(spark):
    """What is made of a customer's patches isn't spelled out for each of them: code that long isn't compiled."""
    for rows in (merges.merge_patches(spark, SF), merges.merge_edges(spark, SF)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("concat(") <= 6


def test_statistics_meet_in_one_shuffle(spark, tmp_path):
    """Versions, lists and authors come together once, and are counted in one pass."""
    line = "struct<line:binary,commit:string>"
    versions = [("r", s, p, s, False, [(t, c) for t, c in lines]) for s, p, lines in (("1", "a.py", [(b"x = 1", "1"), (b"# y", "0"), (b"", "1")]), ("2", "a.py", [(b"z", "1")]), ("2", "LICENSE", [(b"no", "2")]), ("3", "gone.py", []), ("3", "not listed.py", [(b"x", "3")]))]
    tables = {
        "blame": spark.createDataFrame(versions, f"repo string, sha string, path string, blame_commit string, is_binary boolean, lines array<{line}>"),
        "commits": spark.createDataFrame([("r", "1", "Ann", "ann@x"), ("r", "2", "Bob", "bob@x"), ("q", "0", "Eve", "eve@x")], "repo string, sha string, author_name string, author_email string").selectExpr("*", "timestamp '2020-01-02 03:04:05.000006' AS date"),
        "files": spark.createDataFrame([("r", "1", "a.py", "added"), ("r", "2", "a.py", "modified"), ("r", "2", "LICENSE", "added"), ("r", "3", "gone.py", "removed"), ("r", "4", "b.py", "added")], "repo string, sha string, filename string, status string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    read = [spark.read.parquet(f"{tmp_path}/{name}") for name in tables]
    for parts in (None, 2):
        out = stats.file_stats(*read, parts=parts)
        assert exchanges(out) == 1 and out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        rows = {(r.sha, r.filename): r for r in out.collect()}
        assert sorted(rows) == [("1", "a.py"), ("2", "LICENSE"), ("2", "a.py"), ("3", "gone.py")]
        one = rows["1", "a.py"]
        assert (one.language, one.size, one.loc, one.sloc, one.comments, one.blanks, one.skipped, one.status, one.license) == ("Python", 11, 3, 1, 1, 1, "", "added", None)
        assert [(x.name, x.email, x.comment, x.code, x.blank, x.sha) for x in one.lines] == [("Ann", "ann@x", False, True, False, "1"), (None, None, True, False, False, "0"), ("Ann", "ann@x", False, False, True, "1")]
        assert one.lines[0].date == datetime(2020, 1, 2, 3, 4, 5, 6) and one.lines[1].date is None
        assert (rows["2", "LICENSE"].skipped, rows["2", "LICENSE"].lines, rows["3", "gone.py"].skipped, rows["3", "gone.py"].lines) == ("File was on an exclusion list", None, "File was removed", None)
        assert rows["2", "a.py"].lines[0].name == "Ann"


def test_many_lines_of_statistics_keep_their_places(spark):
    made = spark.range(7000).selectExpr("'r' AS repo", "cast(id AS string) AS sha", "concat('f', id, if(id % 3 = 0, '.png', '.py')) AS path", "transform(sequence(1, id % 40 + 1), i -> named_struct('line', cast(concat('x = ', id) AS binary), 'commit', cast(id - i % 3 AS string))) AS lines")
    files = made.selectExpr("repo", "sha", "path AS filename", "'added' AS status")
    commits = made.selectExpr("repo", "sha", "concat('n', sha) AS author_name", "'' AS author_email", "cast(NULL AS timestamp) AS date")
    rows = stats.file_stats(made, commits, files, parts=2).collect()
    assert len(rows) == 7000
    for r in rows:
        n = int(r.sha)
        want = None if n % 3 == 0 else [(f"n{n - i % 3}" if n >= i % 3 else None, f"{n - i % 3}", True) for i in range(1, n % 40 + 2)]
        assert (r.lines and [(x.name, x.sha, x.code) for x in r.lines]) == want and r.loc == len(want or ())
