"""What a path, a size or a text says of a file."""

import pytest
from pyspark.sql import functions as F

from palimpsest import logs
from palimpsest.functions import classify, licenses
from palimpsest.functions.languages import count_lines


def reasons(spark, rows):
    d = spark.createDataFrame(rows, "path string, text string").withColumn("lines", F.split("text", "\n"))
    got = d.select("path", classify.skip_reason(F.col("path"), F.octet_length("text"), F.size("lines"), classify.first_wide_line(F.col("lines")), F.lit(False), F.get("lines", F.lit(0))).alias("r"))
    return [r.r for r in got.collect()]


def test_cascade(spark):
    wide = "x" * 1097
    rows = [
        ("dir1/a.go", "package a"), ("config.json", "{}"), (".config", ""), ("go.sum", ""), ("dependencies/a.go", ""), ("src/com/foo/android/cache/DiskLruCache.java", "class A"),
        ("a.go", "x" * 1_001_000), ("a.go", "\n" * 40_100), ("a.go", wide), ("a", ""), ("run", "#!/usr/bin/env python\nprint()"), ("run", "text"),
    ]
    assert reasons(spark, rows) == [
        "", classify.CONFIG, classify.DOT, classify.EXCLUDED, classify.VENDORED, "", "File size was 1001K which exceeds limit of 1000K", "File has more than 40000 lines",
        "File has a line width of 1097 which is greater than max of 1096", classify.UNKNOWN, "", classify.UNKNOWN,
    ]


def test_licence_paths(spark):
    yes = ["LICENSE", "LICENCE", "LICENSE.txt", "LICENSE.md", "LICENSE-MIT", "LICENSE-APACHE.txt", "UNLICENSE", "COPYING", "COPYING.md", "README", "README.md", "README.txt", "dir/LICENSE"]
    no = ["main.go", "LICENSED.go", "readme.rst"]
    got = spark.createDataFrame([(p,) for p in yes + no], "p string").select(F.col("p").rlike(classify.LICENSE_PATH).alias("r")).collect()
    assert [r.r for r in got] == [True] * len(yes) + [False] * len(no)


def test_licence_texts():
    assert licenses.detect("Copyright 2018\n" + licenses.TEXTS["Apache-2.0"]) == ("Apache-2.0", 1.0)
    name, share = licenses.detect(licenses.TEXTS["MIT"].replace("without limitation the rights to use", "the rights"))
    assert name == "MIT" and 0.9 < share < 1
    assert licenses.detect("nothing of the kind") is None


@pytest.mark.parametrize("language, text, classes", [
    ("Batchfile", "REM a\necho b\n", "mcb"), ("F#", "let a = 1 // x\n(* two\nlines *)\n", "cmmb"), ("Nix", "# a\nx = 1;", "mc"), ("Fortran", "! a\nprint *, 'b ! c'", "mc"),
])
def test_lines_of_more_languages(language, text, classes):
    assert count_lines(language, text.split("\n")).classes == classes


def test_log_values(caplog):
    assert logs.pairs(a=1, b="two words", c='say "x"') == 'a=1 b="two words" c="say \\"x\\""'
    times = logs.Times()
    with caplog.at_level("INFO", "palimpsest"), times.step("fold", path="/x y"):
        pass
    assert 'step=fold' in caplog.text and 'path="/x y"' in caplog.text and times.report()[0][:2] == ("fold", 1)
