"""Queries on files: documents and pages as files of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import classify
from palimpsest.functions.languages import BY_ENDING, BY_NAME
from palimpsest.functions.licenses import TEXTS, THRESHOLD
from palimpsest.operators import stats
from palimpsest.storage import read_table

ENDINGS = {"en": "py", "de": "go", "fr": "json", "es": "unknown"}
URL_PATH = r"^[a-z]+://[^/]+/([^?#]*)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's path with its reason to be left out and its language."""
    path = F.regexp_extract("url", URL_PATH, 1)
    rows = read_table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", classify.path_reason(F.col("path")).alias("reason"), classify.language(F.col("path")).alias("language"))


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the parts' columns, so that every rule applies to some."""
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), F.pmod(F.col("p_partkey"), F.lit(len(FOLDERS))).cast("int") + 1)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), F.pmod(F.floor(F.col("p_partkey") / len(FOLDERS)), F.lit(len(NAMES))).cast("int") + 1)
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.concat(folder, name).alias("path"))
    return rows.select("p_partkey", "path", classify.path_reason(F.col("path")).alias("reason"), classify.language(F.col("path")).alias("language"), F.col("path").rlike(classify.LICENSE_PATH).alias("may_be_license"))


FOLDERS = ("", "src/", "vendor/lib/", "src/cache/", "a/cache/", "dependencies/", ".github/", "dist/", "third_party/x/", "docs/v1/", "node_modules/m/")
NAMES = ("main.go", "config.json", ".config", "go.sum", "LICENSE-MIT.md", "app.min.js", "README", "Makefile", "jquery-1.js", "util.PY", "notes", "x.pdf", "pom.xml", "build.gradle", "a.tar.gz", "VERSION_check.rs", "COPYING.txt")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, lines): a document is a file of its source, of a language by its own."""
    ending = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])[F.col("lang")]
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending)
    return read_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text", F.split("text", "\n").alias("lines"))


def file_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_files(spark, sf_dir)
    reason = classify.skip_reason(F.col("path"), F.octet_length("text"), F.size("lines"), classify.first_wide_line(F.col("lines")), F.lit(False))
    return d.select("doc_id", "path", F.octet_length("text").cast("bigint").alias("size"), F.size("lines").cast("bigint").alias("n_lines"), reason.alias("skipped"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document as plain text."""
    d = document_files(spark, sf_dir).select("doc_id", F.lit("Text").alias("language"), F.transform("lines", lambda x: x.cast("binary")).alias("lines"))
    return stats.counted(d, ["doc_id"]).select("doc_id", "loc", "sloc", "comments", "blanks")


def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document in its language, with its classes of lines."""
    d = document_files(spark, sf_dir).select("doc_id", classify.language(F.col("path")).alias("language"), F.transform("lines", lambda x: x.cast("binary")).alias("lines"))
    return stats.counted(d, ["doc_id"])


def script_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scripts whose name says nothing, so that their first line does."""
    first = F.element_at(F.array(*[F.lit(x) for x in FIRST_LINES]), F.pmod(F.col("p_partkey"), F.lit(len(FIRST_LINES))).cast("int") + 1)
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("bin/tool"), F.when(F.col("p_partkey") % 5 == 0, ".go").otherwise("")).alias("path"), first.alias("first"))
    return rows.select("p_partkey", classify.language(F.col("path"), F.col("first")).alias("language"))


FIRST_LINES = ("#!/bin/sh", "#!/usr/bin/env python3.11", "#! /usr/bin/env -S node --harmony", "#!/usr/local/bin/perl -w", "# no script", "", "#!/usr/bin/unheard-of", "#!/usr/bin/ruby2.7")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a licence file: what it is, if it is one."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.lit("LICENSE").alias("path"), "text")
    return stats.with_license(d, "path", "text").select("doc_id", F.col("license.name").alias("name"), F.col("license.confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (page_paths, part_paths, file_reasons, line_counts, code_counts, script_languages, licenses)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_quoted(pattern)})"


_REASON = f"""CASE WHEN {_matches("path", classify.SETTINGS_PATH)} THEN '{classify.CONFIG}' WHEN {_matches("path", classify.DOT_PATH)} THEN '{classify.DOT}'
  WHEN {_matches("path", classify.EXCLUDED_PATH)} THEN '{classify.EXCLUDED}' WHEN {_matches("path", classify.VENDOR_PATH)} AND NOT starts_with(path, 'src/') THEN '{classify.VENDORED}' ELSE '' END"""
_NAME = "string_split(path, '/')[-1]"
_LANGUAGE = f"""CASE {" ".join(f"WHEN {_NAME} = '{k}' THEN '{v}'" for k, v in BY_NAME.items())} WHEN {_NAME} NOT LIKE '%.%' THEN ''
  {" ".join(f"WHEN lower(string_split({_NAME}, '.')[-1]) = '{k}' THEN '{v}'" for k, v in BY_ENDING.items())} ELSE '' END"""
_FILES = f"""f AS (SELECT doc_id, source || '/' || doc_id || '.' || CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDINGS.items())} END AS path,
  strlen(text) AS size, string_split(text, chr(10)) AS ls FROM documents)"""

_PAIRS = "list_distinct(list_zip(w[:-2], w[2:]))"
ORACLES = {
    "script_languages": f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Go' ELSE (['Shell', 'Python', 'JavaScript', 'Perl', '', '', '', 'Ruby'])[p_partkey % {len(FIRST_LINES)} + 1] END AS language FROM part",
    "licenses": f"""WITH r AS (SELECT name, len({_PAIRS}) AS n, unnest({_PAIRS}) AS p FROM (VALUES {", ".join(f"({_quoted(k)}, string_split({_quoted(v)}, ' '))" for k, v in TEXTS.items())}) AS t(name, w)),
d AS (SELECT doc_id, unnest({_PAIRS}) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE strlen(text) <= {classify.MOST_BYTES})),
s AS (SELECT d.doc_id, r.name, count(*) / any_value(r.n) AS share FROM d JOIN r ON d.p[1] = r.p[1] AND d.p[2] = r.p[2] GROUP BY ALL HAVING share >= {THRESHOLD})
SELECT doc_id, max_by(name, share) AS name, max(share)::FLOAT AS confidence FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
    "page_paths": f"WITH p AS (SELECT page_id, regexp_extract(url, '{URL_PATH}', 1) AS path FROM pages) SELECT page_id, path, {_REASON} AS reason, {_LANGUAGE} AS language FROM p",
    "part_paths": f"""WITH p AS (SELECT p_partkey, ([{", ".join(map(_quoted, FOLDERS))}])[p_partkey % {len(FOLDERS)} + 1] || ([{", ".join(map(_quoted, NAMES))}])[(p_partkey // {len(FOLDERS)}) % {len(NAMES)} + 1] AS path FROM part)
SELECT p_partkey, path, {_REASON} AS reason, {_LANGUAGE} AS language, {_matches("path", classify.LICENSE_PATH)} AS may_be_license FROM p""",
    "file_reasons": f"""WITH {_FILES}, w AS (SELECT *, list_filter(list_transform(ls, lambda x: strlen(x)), lambda n: n > {classify.MOST_WIDTH})[1] AS wide FROM f)
SELECT doc_id, path, size, len(ls) AS n_lines, CASE WHEN size > {classify.MOST_BYTES} THEN 'File size was ' || (size // 1000) || 'K which exceeds limit of 1000K'
  WHEN {_REASON} <> '' THEN {_REASON} WHEN len(ls) > {classify.MOST_LINES} THEN 'File has more than {classify.MOST_LINES} lines'
  WHEN wide IS NOT NULL THEN 'File has a line width of ' || wide || ' which is greater than max of {classify.MOST_WIDTH}' WHEN {_LANGUAGE} = '' THEN '{classify.UNKNOWN}' ELSE '' END AS skipped FROM w""",
    "line_counts": f"""WITH {_FILES} SELECT doc_id, len(ls) AS loc, len(list_filter(ls, lambda x: trim(x) <> '')) AS sloc, 0::BIGINT AS comments, len(list_filter(ls, lambda x: trim(x) = '')) AS blanks FROM f""",
}
