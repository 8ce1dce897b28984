"""Graph walks on small parent maps."""

import random

import pytest

from palimpsest.operators import graph


def commits(parents, default, head):
    return graph.branch_commits(graph.Default(parents, default), head)


CASES = {
    "basic": ({"m1": [], "b1": ["m1"]}, "m1", "b1", ["b1"], ["m1"]),
    "merged": ({"m1": [], "b1": ["m1"], "b2": ["b1"], "m2": ["m1", "b2"]}, "m2", "b2", ["b1", "b2"], ["m1"]),
    "from default twice": ({"m1": [], "m2": ["m1"], "b1": ["m1"], "b2": ["b1", "m2"]}, "m2", "b2", ["b1", "b2"], ["m1"]),
    "separate root": ({"m1": [], "b1": [], "b2": ["b1"]}, "m1", "b2", ["b1", "b2"], []),
    "two ways": ({"m1": [], "b1": ["m1"], "c1": ["m1"], "d1": ["b1", "c1"]}, "m1", "d1", ["b1", "c1", "d1"], ["m1"]),
    "two sources": ({"m1": [], "m2": ["m1"], "m3": ["m1"], "m4": ["m2", "m3"], "b1": ["m2", "m3"]}, "m4", "b1", ["b1"], ["m2", "m3"]),
    "diamond": ({"m1": [], "b1": ["m1"], "b2": ["b1"], "b3": ["b1"], "b4": ["b2", "b3"]}, "m1", "b4", ["b2", "b1", "b3", "b4"], ["m1"]),
}


@pytest.mark.parametrize("name", CASES)
def test_branch_commits(name):
    parents, default, head, own, points = CASES[name]
    assert commits(parents, default, head) == (own, points)


def test_fast_forward_has_all_history():
    line = {"a": [], "b": ["a"], "c": ["b"]}
    assert commits(line, "c", "b") == (["a", "b"], [])


def test_behind_walks_past_the_shared_commits():
    parents = {"m1": [], "m2": ["m1"], "b": ["m2"], "m3": ["m2"], "m4": ["m3", "m1"]}
    assert graph.behind(parents, "m4", graph.descend(parents, "m4"), "b") == 3
    line = {"m1": [], "m2": ["m1"], "m3": ["m2"], "b": ["m1"]}
    assert graph.behind(line, "m3", graph.descend(line, "m3"), "b") == 2
    joined = {"a1": [], "a2": ["a1"], "b1": [], "m": ["a2", "b1"], "f": ["a1"]}
    assert graph.behind(joined, "m", graph.descend(joined, "m"), "f") == 3


def test_earliest_and_merge_commit():
    line = {"m1": [], "m2": ["m1"], "m3": ["m2"]}
    assert graph.earliest(line, ["m1", "m3"]) == ["m1"]
    children = {"b1": ["x", "m2", "m3"]}
    assert graph.merge_commit(children, {"m2", "m3"}, "b1") == "m2"
    assert graph.merge_commit(children, {"q"}, "b1") == ""


def test_last_common_parent():
    parents = {"c1": [], "c2": ["c1"], "c3": ["c1"], "c4": ["c3"], "c5": ["c4"], "c8": ["c4"]}
    assert graph.last_common_parent(parents, ["c2", "c3"]) == "c1"
    assert graph.last_common_parent(parents, ["c5", "c8"]) == "c4"


def test_walks_about_a_branch_are_those_of_the_whole():
    rng = random.Random(3)
    merged = 0
    for _ in range(400):
        n = rng.randrange(2, 14)
        parents = {str(i): [str(p) for p in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2, 2, 3])))] for i in range(n)}
        default = graph.Default(parents, str(n - 1))
        for head in parents:
            if head in default.commits:
                barred = graph.descend(parents, default.head, {head})
                without = default.without(head)
                assert {c for c in parents if c in without} == barred
                merged += head not in default.chain
    assert merged > 300


def test_missing_commit_is_an_error():
    with pytest.raises(graph.UnknownCommit):
        commits({"m1": [], "b1": ["gone"]}, "m1", "b1")


def test_long_chain_doesnt_recurse():
    n = 10_000
    parents = {str(i): [str(i - 1)] if i else [] for i in range(n)} | {"b": ["0"], "m": [str(n - 1), "b"]}
    assert commits(parents, "m", "b") == (["b"], ["0"])


def test_branches_frame(spark):
    edges = spark.createDataFrame([("r", "m1", None, None), ("r", "b1", "m1", 0), ("q", "x", None, None)], "repo string, child string, parent string, parent_ix int")
    refs = spark.createDataFrame([("r", "master", "m1", True), ("r", "b", "b1", False), ("q", "main", "x", True)], "repo string, name string, sha string, is_default boolean")
    pulls = spark.createDataFrame([("r", "b1"), ("r", "nowhere"), ("r", "b1")], "repo string, sha string")
    rows = graph.branches(edges, refs, pulls, include_default=True).collect()
    assert sorted((r.repo, r.name, r.is_pull_request, r.ahead_default_count) for r in rows) == [("q", "main", False, 0), ("r", "", True, 1), ("r", "b", False, 1), ("r", "master", False, 0)]
    assert graph.branches(edges.limit(0), refs, None).count() == 0
