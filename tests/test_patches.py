"""Patches, their application and the texts around them."""

import pytest

from palimpsest.functions import patches as p
from palimpsest.functions.languages import count_lines
from palimpsest.functions.licenses import TEXTS, detect
from palimpsest.operators.blame import Blame, Fold, HistoryError, apply_diff, apply_merge

NEW = b"""diff --git a/f b/f
new file mode 100644
--- /dev/null
+++ b/f
@@ -0,0 +1,3 @@
+one
+two
+three
"""
EDIT = b"""diff --git a/f b/f
--- a/f
+++ b/f
@@ -1,3 +1,3 @@ heading @@ x
 one
-two
+TWO
\tthree
\\ No newline at end of file
"""


def test_headers():
    assert p.hunk_header(b"@@ -1,8 +1,6 @@ func @@") == ((False, 1, 8), (True, 1, 6))
    assert p.hunk_header(b"@@ -1 +1,2 @@") == ((False, 0, 1), (True, 1, 2))
    assert len(p.hunk_header(b"@@@ -1,2 -3,4 +5,6 @@@")) == 3
    for bad in (b"@@ x @@", b"none", b"@@ -1,2"):
        with pytest.raises(p.PatchError):
            p.hunk_header(bad)


def test_declarations():
    assert p.declared_paths(b"diff --git a/x b/y") == ("x", "y")
    assert p.declared_paths(b"diff --git a/a b b/a b") == ("a b", "a b")
    assert p.declared_paths(b"diff --git a/a b b/c d e") is None
    assert p.declared_paths(b"diff --combined x") is None
    assert p.declared_paths(b'diff --git "a/x" "b/x"') == ("x", "x")
    with pytest.raises(p.PatchError):
        p.declared_paths(b"diff --git x")


def test_file_diffs():
    assert p.file_diff(NEW)[:3] == ("", "f", False)
    gone = p.file_diff(b"diff --git a/f b/f\ndeleted file mode 100644\n--- a/f\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")
    assert gone == ("f", "", False, ())
    moved = p.file_diff(b"diff --git a/a x b/b y z\nsimilarity index 100%\nrename from a x\nrename to b y z\n")
    assert moved == ("a x", "b y z", False, ())
    assert p.file_diff(b"diff --git a/i b/i\nBinary files a/i and b/i differ\n").binary
    assert p.file_diff(b"") == p.FileDiff()


def test_log():
    text = b"commit a\nAuthor: x\n\n    commit said\n\n" + NEW + b"\ncommit b (from a)\nMerge: a c\nAuthor: x\n\n    m\n\ncommit b (from c)\nAuthor: x\n\n    m\n\n" + EDIT + b"\n"
    got = list(p.patch_log(text.splitlines(keepends=True)))
    assert [(r.sha, r.against, len(r.changes)) for r in got] == [("a", "", 1), ("b", "a", 0), ("b", "c", 1)]
    assert list(p.patch_log([])) == []


def test_apply():
    first = apply_diff(Blame("c1"), p.file_diff(NEW), "c1")
    second = apply_diff(first, p.file_diff(EDIT), "c2")
    assert second.lines == (b"one", b"TWO", b"three") and second.owners == ("c1", "c2", "c1")
    with pytest.raises(HistoryError):
        apply_diff(Blame("c1"), p.file_diff(EDIT), "c2")


def test_merge_owners():
    a, b = Blame("a", (b"x", b"y"), ("o", "a")), Blame("b", (b"x",), ("o",))
    add = p.FileDiff("f", "f", False, (p.Hunk(p.hunk_header(b"@@ -1,2 +1,3 @@"), (b" x", b" y", b"+z")),))
    both = p.FileDiff("f", "f", False, (p.Hunk(p.hunk_header(b"@@ -1,1 +1,3 @@"), (b" x", b"+y", b"+z")),))
    assert apply_merge([a, b], [add, both], "m").owners == ("o", "a", "m")


def test_fold_renames_and_binaries():
    fold = Fold()
    fold.step("c1", [], {"": [p.file_diff(b"diff --git a/i b/i\nnew file mode 1\nBinary files /dev/null and b/i differ\n"), p.file_diff(NEW)]})
    shown = fold.step("c2", ["c1"], {"": [p.file_diff(b"diff --git a/i b/j\nrename from i\nrename to j\n"), p.file_diff(b"diff --git a/f b/g\nrename from f\nrename to g\n")]})
    assert shown["j"].commit == "c1" and shown["j"].binary
    assert shown["g"].commit == "c2" and set(shown["g"].owners) == {"c1"}
    assert set(fold.trees["c2"]) == {"j", "g"}
    assert fold.step("c3", ["c2"], {}) == {} and set(fold.trees["c3"]) == {"j", "g"}


def test_line_counts():
    got = count_lines("Go", ["package main", "", "// hi", "/* a", "b */ x := \"/*\" // c", "if a && b {", "}", "/* z */"])
    assert got[:5] == (8, 4, 3, 1, 2) and got.classes == "cbmmcccm"
    made = count_lines("Python", ["x = 1", "# GENERATED", "y"])
    assert made.generated and made.loc == 2 and made.classes == "cm-"
    assert count_lines("Unknown", ["x"]).sloc == 1 and count_lines("Go", []).loc == 0


def test_licenses():
    assert detect("Copyright me\n" + TEXTS["MIT"]) == ("MIT", 1.0)
    assert detect("nothing of the kind") is None
