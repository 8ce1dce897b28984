"""A stream of patches gives the lines that one fold gives."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blame
from palimpsest.plans.history import order_commits, order_edges, order_patches
from palimpsest.schemas import PATCHES
from palimpsest.streaming import checkpoint
from palimpsest.streaming.incremental import IncrementalFold, start

SF = "/root/testdata/sf0.001"


def test_stream(spark, tmp_path):
    commits = order_commits(spark, SF).filter("repo < 20")
    patches, edges = order_patches(commits), order_edges(commits)
    for i, part in enumerate((patches.filter("seq <= 4"), patches.filter("seq BETWEEN 5 AND 9"), patches.filter("seq > 9"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(PATCHES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    fold = IncrementalFold(edges, f"{tmp_path}/state", lambda df, n: seen.extend(blame.blame_lines(df).collect()))
    start(stream, fold, f"{tmp_path}/offsets").awaitTermination()
    want = blame.blame_lines(blame.blame_history(patches, edges)).collect()
    assert sorted(seen) == sorted(want)


def test_checkpoint_versions(spark, tmp_path):
    rows = [("r", "c", "f", "c", False, [(b"\xff\x00", "b"), (b"", "c")]), ("r", "c", "g", "c", True, [])]
    live = spark.createDataFrame(rows, "repo string, sha string, path string, blame_commit string, is_binary boolean, lines array<struct<line:binary,commit:string>>").withColumn("live", F.lit(True))
    folder = f"{tmp_path}/s"
    with pytest.raises(checkpoint.UnexpectedCheckpoint):
        checkpoint.read_state(spark, folder)
    checkpoint.write_state(live, folder, "one")
    checkpoint.write_state(live, folder, "two")
    with pytest.raises(checkpoint.UnexpectedCheckpoint):
        checkpoint.read_state(spark, folder, "one")
    assert sorted(map(repr, checkpoint.read_state(spark, folder, "two").collect())) == sorted(map(repr, live.drop("live").collect()))


def test_a_state_is_read_by_one_shuffle(spark, tmp_path):
    commits = order_commits(spark, SF)
    live = blame.fold_history(order_patches(commits), None).filter("live").drop("live")
    parts = [live.filter("repo < 40"), live.filter("repo >= 20")]
    for i, (rows, name) in enumerate(zip(parts, "ab")):
        checkpoint.write_state(rows, f"{tmp_path}/s", name, i)
    read = checkpoint.read_state(spark, f"{tmp_path}/s", parts=2)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(repr, read.collect())) == sorted(map(repr, live.collect()))  # repositories of both parts come once
    old = checkpoint.read_state(spark, f"{tmp_path}/s", "a", 0)
    assert sorted(map(repr, old.collect())) == sorted(map(repr, parts[0].collect()))
