"""Repositories made here, read through the data sources, against git's own answers."""

import os
import subprocess

import pytest

from palimpsest.__main__ import main
from palimpsest.engine import HistoryEngine, Options
from palimpsest.operators import stats
from palimpsest.operators.validate import differences
from palimpsest.sources.git import GitError, lines_of
from palimpsest.sources.repos import each_repo, find_repos
from palimpsest.streaming import checkpoint
from palimpsest.streaming.checkpoint import UnexpectedCheckpoint


def git(folder, *args, day=1):
    when = f"2020-01-{day:02d}T10:00:00+0100"
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=A B", "-c", "user.email=a@b.c", *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def put(folder, name, text, day):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    git(folder, "add", "-A")
    git(folder, "commit", "-qm", f"day {day}", day=day)
    return git(folder, "rev-parse", "HEAD")


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    one = root / "one"
    one.mkdir()
    git(one, "init", "-q", "-b", "master")
    put(one, "main.go", "package main\n\n// first\nfunc main() {\n\tif true {\n\t}\n}\n", 1)
    put(one, "a b.txt", "alpha line one\nbeta line two\ngamma line three\n", 2)
    put(one, "i.png", b"\x00\x01binary", 3)
    git(one, "checkout", "-qb", "side")
    put(one, "a b.txt", "alpha line one\nbeta changed on side\ngamma line three\n", 4)
    git(one, "checkout", "-q", "master")
    put(one, "a b.txt", "alpha line one\nbeta line two\ngamma line three\ndelta added on master\n", 5)
    git(one, "merge", "-q", "--no-ff", "-m", "merge", "side", day=6)
    git(one, "mv", "main.go", "cmd.go")
    put(one, "i.png", "now it is text\n", 7)
    git(one, "rm", "-q", "a b.txt")
    git(one, "commit", "-qm", "gone", day=8)
    git(one, "checkout", "-qb", "open", "HEAD~1")
    put(one, "x.py", "# GENERATED\nx = 1\n", 9)
    git(one, "checkout", "-q", "master")
    (root / "empty").mkdir()
    git(root / "empty", "init", "-q")
    return root


def test_discovery(repos):
    assert [os.path.basename(r) for r in find_repos(str(repos))] == ["empty", "one"]
    assert each_repo(str(repos), lambda r: 1 / 0)[0][0].endswith("empty")


def test_lines_as_git_has_them(spark, repos):
    engine = HistoryEngine(spark, Options(str(repos)))
    assert engine.blame().count() >= 8
    assert differences(engine).collect() == []


def test_code(spark, repos):
    rows = {(r.ordinal, r.filename): r for r in (lambda e: e.code().join(e.commits().select("repo", "sha", "ordinal"), ["repo", "sha"]).collect())(HistoryEngine(spark, Options(str(repos))))}
    first = rows[1, "main.go"]
    assert (first.language, first.loc, first.sloc, first.comments, first.blanks, first.complexity, first.status) == ("Go", 7, 5, 1, 1, 1, "added")
    assert first.lines[2].comment and first.lines[0].name == "A B"
    gone = next(r for (o, n), r in rows.items() if n == "a b.txt" and r.status == "removed")
    assert gone.skipped == "File was removed" and gone.lines is None


def test_branches(spark, repos):
    engine = HistoryEngine(spark, Options(str(repos), all_branches=True, include_default=True))
    rows = {r.name: r for r in engine.branches().collect()}
    assert set(rows) == {"master", "side", "open"}
    assert rows["side"].is_merged and rows["side"].ahead_default_count == 1 and rows["side"].merge_commit
    assert not rows["open"].is_merged and (rows["open"].ahead_default_count, rows["open"].behind_default_count) == (1, 1)
    with pytest.raises(ValueError):
        HistoryEngine(spark, Options(str(repos))).branches()


def test_resume(spark, repos, tmp_path):
    one, state = str(repos / "one"), str(tmp_path / "state")
    whole = HistoryEngine(spark, Options(one)).blame().count()
    head = git(repos / "one", "rev-parse", "HEAD")
    assert HistoryEngine(spark, Options(one, checkpoints=state)).blame().count() == whole
    later = Options(one, checkpoints=state, commit_from=head, inclusive=False)
    assert HistoryEngine(spark, later).blame().count() == 0
    with pytest.raises(UnexpectedCheckpoint):
        HistoryEngine(spark, Options(one, checkpoints=state, commit_from="0" * 40, inclusive=False)).blame()


def test_cached(spark, repos):
    engine = HistoryEngine(spark, Options(str(repos)))
    whole = sorted(map(repr, engine.commits().collect()))
    assert [sorted(map(repr, engine.cached("commit_log").collect())) for _ in range(2)] == [whole, whole]


def test_command_line(spark, repos, capsys, tmp_path):
    assert main(["branches", str(repos)]) == 0
    assert "open" in capsys.readouterr().out
    assert main(["code", str(tmp_path)]) == 1


def counting(tmp_path):
    """A git that writes down what it's asked for."""
    program, said = tmp_path / "git.sh", tmp_path / "said"
    program.write_text(f'#!/bin/sh\necho "$@" >> {said}\nexec git "$@"\n')
    program.chmod(0o755)
    return str(program), said


def test_code_folds_once(spark, repos, tmp_path):
    program, said = counting(tmp_path)
    engine = HistoryEngine(spark, Options(str(repos), git=program))
    for _ in range(2):
        assert engine.code().collect() and engine.code_by_commit().collect()
    asked = said.read_text().splitlines()
    assert sum(" -p " in a for a in asked) == 1 and sum("--numstat" in a for a in asked) == 1
    assert {"fold", "commits", "commit_files", "edges"} <= {n for n, _, _ in engine.times.report()}


def test_repository_table(spark, repos):
    assert [(r.repo, r.is_bare) for r in HistoryEngine(spark, Options(str(repos))).repos().orderBy("repo").collect()] == [("empty", False), ("one", False)]


def test_roots_and_limits(spark, repos):
    first = git(repos / "one", "rev-list", "--max-parents=0", "HEAD")
    assert [tuple(r) for r in HistoryEngine(spark, Options(str(repos))).roots().collect()] == [("one", first)]
    few = HistoryEngine(spark, Options(str(repos), limit=2))
    assert few.commits().count() == 2 and few.blame().select("sha").distinct().count() == 2 and few.code().count() == 2
    inclusive = HistoryEngine(spark, Options(str(repos), commit_from=first))
    assert inclusive.commits().count() == HistoryEngine(spark, Options(str(repos))).commits().count()


def test_strict_checks(spark, repos):
    engine = HistoryEngine(spark, Options(str(repos)))
    shown, commits, files = engine.blame(), engine.commits(), engine.commit_files()
    stats.check_matched(shown, commits, files)
    sha = shown.first().sha
    with pytest.raises(stats.UnmatchedVersion, match="unknown commit"):
        stats.file_stats(shown, commits.filter(commits.sha != sha), files, strict=True)
    with pytest.raises(stats.UnmatchedVersion, match="renamed"):
        stats.file_stats(shown.filter("path <> 'cmd.go'"), commits, files, strict=True)


def test_each_repository_resumes_where_it_was(spark, tmp_path):
    state = str(tmp_path / "state")
    root = tmp_path / "repos"
    heads = {}
    for name in ("a", "b", "c"):
        (root / name).mkdir(parents=True)
        git(root / name, "init", "-q", "-b", "master")
        if name != "c":
            put(root / name, "f.txt", f"{name} one\n", 1)
            heads[name] = put(root / name, "f.txt", f"{name} one\n{name} two\n", 2)
    assert HistoryEngine(spark, Options(str(root), checkpoints=state)).blame().count() == 4
    assert {r.repo: r.version for r in checkpoint.versions(spark, state).collect()} == heads
    heads["a"] = put(root / "a", "f.txt", "a zero\na one\na two\n", 3)
    heads["c"] = put(root / "c", "f.txt", "c one\n", 3)
    more = HistoryEngine(spark, Options(str(root), checkpoints=state, resume=True)).blame().collect()
    assert {(r.repo, len(r.lines)) for r in more} == {("a", 3), ("c", 1)}
    assert len({x.commit for r in more if r.repo == "a" for x in r.lines}) == 3
    assert {r.repo: r.version for r in checkpoint.versions(spark, state).collect()} == heads
    put(root / "b", "f.txt", "b one\nb two\nb three\n", 4)  # b was last touched two states ago
    last = HistoryEngine(spark, Options(str(root), checkpoints=state, resume=True)).blame().collect()
    assert [(r.repo, len({x.commit for x in r.lines})) for r in last] == [("b", 3)]


def test_errors_of_git_do_not_block(tmp_path):
    program = tmp_path / "git.sh"
    program.write_text("#!/bin/sh\nhead -c 1000000 /dev/zero | tr '\\0' x >&2\necho line\nexit $CODE\n")
    program.chmod(0o755)
    os.environ["CODE"] = "0"
    assert list(lines_of(str(program), ".", "log")) == [b"line\n"]
    os.environ["CODE"] = "3"
    with pytest.raises(GitError, match="log: xxx"):
        list(lines_of(str(program), ".", "log"))
    reader = lines_of("yes", "/")  # never ends by itself: a reader that stops ends it
    reader.close()


def test_totals_and_exit_codes(spark, repos, capsys, tmp_path):
    assert main(["code", str(repos), "--profile", str(tmp_path / "profile")]) == 0
    said = capsys.readouterr().out
    assert "repositories: 2, without commits: 1, with entries: 1" in said and "fold: 1 x" in said
    assert (tmp_path / "profile").stat().st_size > 0
    assert main(["validate", str(repos)]) == 0
    assert main(["dump", str(repos)]) == 0 and "beta changed on side" in capsys.readouterr().out
    assert main(["code", str(repos), "--sha", "0" * 40]) == 1


def test_trees_and_returns(spark, tmp_path):
    one = tmp_path / "one"
    one.mkdir()
    git(one, "init", "-q", "-b", "master")
    put(one, "a.txt", "first\r\nsecond line here\r\n", 1)
    put(one, "dir/b c.txt", "x\n", 2)
    put(one, "a.txt", "first\r\nsecond line changed\r\nthird line added\r\n", 3)
    engine = HistoryEngine(spark, Options(str(one)))
    assert sorted(r.path for r in engine.read("tree").collect()) == ["a.txt", "dir/b c.txt"]
    assert sorted(r.path for r in engine.read("tree", commit="HEAD~2").collect()) == ["a.txt"]
    assert differences(engine).collect() == []
    last = max((r for r in engine.blame().filter("path = 'a.txt'").collect()), key=lambda r: len(r.lines))
    assert [bytes(x.line) for x in last.lines] == [b"first", b"second line changed", b"third line added"]
    assert [r.name for r in engine.read("refs").collect()] == ["master"]
    git(one, "checkout", "-q", "HEAD~1")
    with pytest.raises(Exception, match="detached"):
        engine.read("refs").collect()
