"""File statistics: counted lines, skipped files, and who wrote each line."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import classify, licenses
from palimpsest.functions.languages import count_lines
from palimpsest.operators.blame import LINES, column_values

COUNTS = "loc bigint, sloc bigint, comments bigint, blanks bigint, complexity bigint, generated boolean, classes string"


def _decoded(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def counted(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and counts of files (keys.., language, lines array<binary>)."""

    def run(batches):
        for b in batches:
            n = len(keys)
            found = [count_lines(lang or "", [_decoded(x) for x in lines or ()]) for lang, lines in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], [*keys, "loc", "sloc", "comments", "blanks", "complexity", "generated", "classes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keys).schema)
    return files.select(*keys, "language", "lines").mapInArrow(run, f"{kinds}, {COUNTS}")


def with_license(files: DataFrame, path: str, content: str, threshold: float = licenses.THRESHOLD) -> DataFrame:
    """``files`` with a column ``license`` struct<name, confidence>, null unless the
    path may be a licence's and the text is one. Only such files reach Python."""

    @F.pandas_udf("name string, confidence float")
    def found(texts):
        import pandas as pd

        got = [licenses.detect(t or "", threshold) for t in texts]
        return pd.DataFrame({"name": [g and g[0] for g in got], "confidence": [g and g[1] for g in got]})

    may = files[path].rlike(classify.LICENSE_PATH) & (F.octet_length(files[content]) <= classify.MOST_BYTES)
    asked = files.filter(may).withColumn("license", found(F.col(content).cast("string")))
    asked = asked.withColumn("license", F.when(F.col("license.name").isNotNull(), F.col("license")))
    return asked.unionByName(files.filter(~F.coalesce(may, F.lit(False))).withColumn("license", F.lit(None).cast("struct<name:string,confidence:float>")))


#: Kinds of rows, as they come in each repository (and share of its commits): authors; of each path, what became of it and its version.
WHO, LISTED, VERSION = range(3)
PERSON = "name:string,email:string,date:timestamp"
STATS = (
    "repo string, sha string, filename string, language string, size bigint, loc bigint, sloc bigint, comments bigint, blanks bigint, complexity bigint, weighted_complexity double, "
    f"skipped string, license struct<name:string,confidence:float>, status string, lines array<struct<{PERSON},comment:boolean,code:boolean,blank:boolean,sha:string>>"
)
COLUMNS = ("repo", "kind", "sha", "path", "name", "email", "status", "size", "skipped", "language", "may", "lines")
NOBODY = (None, None, None)


def _judged(blame: DataFrame) -> DataFrame:
    """``blame`` with what columns can say: size, why it is left out unless as a licence, language, whether it may be a licence."""
    texts = F.transform("lines", lambda x: x.line)
    size = F.coalesce(F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x.line) + 1), F.lit(0)).cast("bigint")
    path, first = F.col("path"), F.decode(F.get(F.col("lines"), F.lit(0))["line"], "UTF-8")
    rows = blame.filter("path <> ''").select("repo", "sha", "path", "lines", size.alias("size"))
    reason = classify.skip_reason(path, F.col("size"), F.size("lines"), classify.first_wide_line(texts), F.lit(False), first)
    may = path.rlike(classify.LICENSE_PATH) & (F.col("size") <= classify.MOST_BYTES)
    rows = rows.select("*", reason.alias("skipped"), may.alias("may"))
    return rows.withColumn("language", F.when(F.col("skipped") == "", classify.language(path, first)).otherwise(""))


def _stat(lines: tuple[bytes, ...], size: int, skipped: str, language: str, may: bool) -> tuple:
    """(language, size, loc, sloc, comments, blanks, complexity, skipped, license, classes or None if its lines aren't shown)"""
    if may:
        found = licenses.detect("".join(_decoded(x) + "\n" for x in lines))
        if found:
            return "", 0, 0, 0, 0, 0, 0, classify.LICENSE, {"name": found[0], "confidence": found[1]}, None
    if skipped:
        return "", 0, 0, 0, 0, 0, 0, skipped, None, None
    n = count_lines(language, [_decoded(x) for x in lines])
    return "" if n.generated else language, size, n.loc, n.sloc, n.comments, n.blanks, n.complexity, classify.GENERATED if n.generated else "", None, n.classes


def _stat_rows(rows: list[tuple], date: pa.DataType) -> pa.RecordBatch:
    """Rows (repo, sha, filename, what ``_stat`` gives, status, commits of the lines and authors or None)."""
    kinds = [pa.string()] * 4 + [pa.int64()] * 6 + [pa.string(), pa.struct([("name", pa.string()), ("confidence", pa.float32())])]
    made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    shown = [(r[12], r[14]) if r[12] and r[14] else None for r in rows]
    classes = "".join(x[0] for x in shown if x)
    people = [p for x in shown if x for p in x[1][1]]
    fields = [pa.array([p[i] for p in people], kind) for i, kind in enumerate((pa.string(), pa.string(), date))]
    fields += [pa.array([c == of for c in classes], pa.bool_()) for of in "mcb"]
    fields.append(pa.array([c for x in shown if x for c in x[1][0]], pa.string()))
    ends = list(accumulate((len(x[0]) if x else 0 for x in shown), initial=0))
    offsets = pa.array([end if x else None for end, x in zip(ends, shown)] + [ends[-1]], pa.int32())
    lines = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, [*(f.split(":")[0] for f in PERSON.split(",")), "comment", "code", "blank", "sha"]))
    made = [*made[:10], pa.array([0.0] * len(rows), pa.float64()), *made[10:], pa.array([r[13] for r in rows], pa.string()), lines]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in STATS.split(", ")])


def file_stats(blame: DataFrame, commits: DataFrame, commit_files: DataFrame, strict: bool = False, parts: int | None = None) -> DataFrame:
    """(repo, sha, filename, language, size, loc .. blanks, complexity, weighted_complexity,
    skipped, license, status, lines) for each file version that its commit lists.

    Each line has its author's name, address and date, null if its commit isn't known.
    With ``strict``, a version of a commit that isn't among ``commits`` is an error, and so is a
    renamed file that its commit shows under no name; without, both are left out.

    One shuffle by repository brings versions, lists and authors together (into ``parts`` parts if given),
    then a part streams its rows and holds the authors of one repository. Without ``parts`` there may be few large
    repositories: each one's commits are dealt out to the cores, and its authors go to all shares.
    """
    if strict:
        check_matched(blame, commits, commit_files)
    shares = 1 if parts else blame.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        out, held, repo, who, key, listed, kind_of_date = [], 0, None, {}, None, [], None
        for b in batches:
            dates = b.column("date")
            kind_of_date = dates.type
            for name, kind, sha, path, author, email, status, size, skipped, language, may, lines, date, share in zip(*(column_values(b.column(c)) for c in COLUMNS), column_values(dates.cast(pa.int64())), b.column("share").to_pylist()):
                if (name, share) != repo:
                    repo, who = (name, share), {}
                if kind == WHO:
                    who[sha] = (author, email, date)
                    continue
                if (name, share, sha, path) != key:
                    key, listed = (name, share, sha, path), []
                if kind == LISTED:
                    listed.append(status)
                    continue
                texts, owners = lines or ((), ())
                for status in listed:
                    if status == "removed":
                        found = ("", 0, 0, 0, 0, 0, 0, classify.REMOVED, None, None)
                    else:
                        found = _stat(texts, size, skipped, language, may)
                    shown = (owners, [who.get(c, NOBODY) for c in owners]) if found[9] else None
                    out.append((name, sha, path, *found, status, shown))
                    held += len(owners) if shown else 0
                if held > 50_000 or len(out) > 2000:
                    yield _stat_rows(out, kind_of_date)
                    out, held = [], 0
        if out:
            yield _stat_rows(out, kind_of_date)

    kinds = {"path": "string", "name": "string", "email": "string", "date": "timestamp", "status": "string", "size": "bigint", "skipped": "string", "language": "string", "may": "boolean", "lines": LINES}
    share = (lambda c: F.lit(0)) if shares == 1 else (lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int"))

    def of(kind: int, frame: DataFrame, share, **columns: str) -> DataFrame:
        return frame.select("repo", F.lit(kind).alias("kind"), "sha", share.alias("share"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    every = F.lit(0) if shares == 1 else F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    rows = of(WHO, commits.select("repo", "sha", "author_name", "author_email", "date"), every, name="author_name", email="author_email", date="date")
    rows = rows.unionByName(of(LISTED, commit_files, share("sha"), path="filename", status="status"))
    rows = rows.unionByName(of(VERSION, _judged(blame), share("sha"), **{c: c for c in ("path", "size", "skipped", "language", "may", "lines")}))
    apart = rows.repartition(parts, "repo") if parts else rows.repartition("repo", "share")
    order = ("repo", "share", F.col("kind") != WHO, "sha", "path", "kind")
    return apart.sortWithinPartitions(*order).select(*COLUMNS, "date", "share").mapInArrow(run, STATS)


class UnmatchedVersion(ValueError):
    """A version whose commit, or a renamed file that its commit's log, doesn't have."""


def unmatched(blame: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, sha) of versions whose commit isn't among ``commits``: none in a sound history."""
    return blame.select("repo", "sha").distinct().join(commits.select("repo", "sha"), ["repo", "sha"], "left_anti")


def lost_renames(blame: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repo, sha, filename) of renamed files that the fold doesn't show, though it shows their commit."""
    seen = blame.select("repo", "sha", F.col("path").alias("filename"))
    renamed = commit_files.filter("renamed AND status <> 'removed'").select("repo", "sha", "filename")
    return renamed.join(seen.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi").join(seen, ["repo", "sha", "filename"], "left_anti")


def check_matched(blame: DataFrame, commits: DataFrame, commit_files: DataFrame) -> None:
    for kind, rows in (("a version of an unknown commit", unmatched(blame, commits)), ("a renamed file that isn't shown", lost_renames(blame, commit_files))):
        if (first := rows.first()) is not None:
            raise UnmatchedVersion(f"{kind}: {first.asDict()}")
