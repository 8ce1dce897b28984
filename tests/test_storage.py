"""Written tables and the size check of broadcasts."""

import os

from pyspark.sql import functions as F

from palimpsest.storage import discard, row_width, small_side, stash, stashed_bytes


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString()


def test_broadcasts_are_checked_by_files_and_rows(spark):
    few = stash(spark.range(1000), "few")
    assert hinted(small_side(few)) and not hinted(small_side(few, 1000))
    same = stash(spark.range(300_000).select(F.lit(1).cast("bigint").alias("x")), "same")  # compresses to almost nothing
    assert 4 * stashed_bytes(same) < 1 << 20 < 300_000 * row_width(same.schema)
    assert not hinted(small_side(same, 1 << 20)) and hinted(small_side(same, 1 << 24))


def test_tables_are_removed(spark):
    table = stash(spark.range(10), "gone")
    folder = table.stash_path.removeprefix("file:")
    assert table.count() == 10 and os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)
