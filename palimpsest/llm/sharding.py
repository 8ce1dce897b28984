"""Operator 9, sharding by extendible hashing.

The directory is indexed by the leading bits of a document's hash. A bucket
whose documents exceed the byte limit splits on the next bit, and only such a
bucket, until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import small_side, stash

HASH_BITS = 60


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the id as text; a null id hashes as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def directory(cells: DataFrame, limit: int, base: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """From (cell, bytes) by ``base + depth`` leading bits: the cells with their
    shard's depth, and those still oversized at the last bit."""
    levels = F.explode(F.sequence(F.lit(base), F.lit(base + depth))).alias("d")
    bucket = F.expr(f"shiftright(cell, {base + depth} - d)")
    sums = cells.select("bytes", levels, "cell").groupBy("d", bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes"))
    fits = sums.filter(F.col("bytes") <= limit).select("d", "bucket")
    found = cells.select("cell", levels).withColumn("bucket", bucket).join(fits, ["d", "bucket"]).groupBy("cell").agg(F.min("d").alias("depth"))
    return found, cells.join(found, "cell", "left_anti").select("cell")


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int | None = None) -> DataFrame:
    """(doc_id, bytes, shard, depth) of every row; ``shard`` is the hash's leading
    ``depth`` bits as text, empty if all documents fit one.

    Bytes are the text's in UTF-8; null and empty texts take none. Rows with one
    id have one hash: they stay together, and if they alone exceed ``limit`` their
    shard has all 60 bits. Only such a shard is over the limit. A null id is an
    id like another. Only the two named columns are read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"))
    rows = stash(rows.withColumn("h", hash_of(F.col("doc_id"))), "hashes")
    whole = rows.agg(F.sum("bytes")).first()[0] or 0
    step = step or min(24, max(4, math.ceil(math.log2(max(1, whole / limit))) + 4))
    base, done, left = 0, None, rows
    while True:
        depth = min(step, HASH_BITS - base)
        cell = F.shiftright("h", HASH_BITS - base - depth)
        cells = stash(left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        found, over = (stash(x, "directory") for x in directory(cells, limit, base, depth))
        keyed = left.withColumn("cell", cell)
        part = keyed.join(small_side(found), "cell").drop("cell")
        done = part if done is None else done.unionByName(part)
        if over.isEmpty():
            break
        left = keyed.join(small_side(over), "cell", "left_semi").drop("cell")
        base += depth
        if base >= HASH_BITS:
            done = done.unionByName(left.withColumn("depth", F.lit(HASH_BITS)))
            break
    return done.select("doc_id", "bytes", F.expr(f"substring(lpad(bin(h), {HASH_BITS}, '0'), 1, depth)").alias("shard"), F.col("depth").cast("bigint").alias("depth"))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows and columns of ``docs``, one folder for each shard."""
    placed = shards(docs, limit, id_col, text_col).select("doc_id", "shard").distinct()
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = placed.select(F.col("doc_id").alias(f"{name}_id"), F.concat(F.lit("b"), "shard").alias(name))
    joined = docs.join(placed, docs[id_col].eqNullSafe(placed[f"{name}_id"])).drop(f"{name}_id")
    joined.repartition(name).write.partitionBy(name).parquet(path)


def shards_sql(limit: int) -> str:
    """The same rows of ``documents``: the depth is the first at which the
    bucket's bytes fit."""
    return f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         lpad(bin(('0x' || substring(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT), {HASH_BITS}, '0') AS bits FROM documents),
d AS (SELECT h.*, unnest(range(0, {HASH_BITS + 1})) AS depth FROM h),
s AS (SELECT doc_id, bytes, bits, depth, sum(bytes) OVER (PARTITION BY depth, substring(bits, 1, depth)) AS total, row_number() OVER (PARTITION BY depth, doc_id, bytes) AS copy FROM d),
f AS (SELECT doc_id, bytes, bits, copy, min(CASE WHEN total <= {limit} OR depth = {HASH_BITS} THEN depth END) AS depth FROM s GROUP BY ALL)
SELECT doc_id, bytes, substring(bits, 1, depth) AS shard, depth::BIGINT AS depth FROM f"""
