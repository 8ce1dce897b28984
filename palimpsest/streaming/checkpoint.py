"""State of a fold as tables: trees, versions, line texts, each text once.

A state is a numbered list of repositories, each with its version and the part that holds
it. A part has the repositories of one run; those of other runs stay in theirs.
A list counts once it is whole, so that a run that breaks off changes nothing. The list
before the newest one stays, older ones go with the parts that no list names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.blame import Blame, blame_rows, column_values
from palimpsest.schemas import BLAME

TABLES = {
    "trees": "repo string, part string, sha string, path string, blame_id string",
    "blames": "repo string, part string, blame_id string, blame_commit string, is_binary boolean, lines array<struct<id:string,commit:string>>",
    "lines": "repo string, part string, id string, line binary",
}


class UnexpectedCheckpoint(RuntimeError):
    """There's no checkpoint, or one of another version than asked for."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The lists that are whole, oldest first."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path(folder))]
    return sorted(int(n[5:]) for n in names if n.startswith("list-") and fs.exists(path(f"{folder}/{n}/_SUCCESS")))


def versions(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """(repo, version, part) of a list, the newest one unless it is named."""
    known = numbers(spark, folder)
    if not known or (number is not None and number not in known):
        raise UnexpectedCheckpoint(f"no checkpoint in {folder}" + (f" with number {number}" if known else ""))
    return spark.read.parquet(f"{folder}/list-{known[-1] if number is None else number}")


def write_state(live: DataFrame, folder: str, version: str | DataFrame, number: int | None = None) -> None:
    """Write the live rows of a fold. ``version``: of all their repositories, or (repo, version);
    repositories that aren't among them keep what the list before ``number`` has. By
    default ``number`` follows the newest one; a list of that number is replaced."""
    spark = live.sparkSession
    fs, path = _fs(spark, folder)
    known = [n for n in numbers(spark, folder) if number is None or n < number]
    number = number if number is not None else (known[-1] + 1 if known else 0)
    if not isinstance(version, DataFrame):
        version = live.select("repo").distinct().withColumn("version", F.lit(version))
    part = f"part-{uuid.uuid4().hex}"
    plain = F.transform("lines", lambda x: F.concat(F.hex(x.line), F.lit(":"), x.commit))
    key = F.sha2(F.concat_ws("|", "repo", "path", "blame_commit", F.col("is_binary").cast("string"), F.array_join(plain, ",")), 256)
    rows = live.select("repo", F.lit(part).alias("part"), "sha", "path", "blame_commit", "is_binary", F.transform("lines", lambda x: F.struct(F.sha2(x.line, 256).alias("id"), x.line.alias("line"), x.commit.alias("commit"))).alias("lines"), key.alias("blame_id"))
    rows.select("repo", "part", "sha", "path", "blame_id").write.parquet(f"{folder}/{part}/trees")
    one = rows.select("repo", "part", "blame_id", "blame_commit", "is_binary", F.transform("lines", lambda x: F.struct(x.id.alias("id"), x.commit.alias("commit"))).alias("lines"))
    one.dropDuplicates(["repo", "blame_id"]).write.parquet(f"{folder}/{part}/blames")
    rows.select("repo", "part", F.explode("lines").alias("l")).select("repo", "part", "l.id", "l.line").dropDuplicates(["repo", "id"]).write.parquet(f"{folder}/{part}/lines")
    listed = version.select("repo", "version", F.lit(part).alias("part"))
    if known:
        kept = versions(spark, folder, known[-1])
        listed = listed.unionByName(kept.join(listed.select("repo"), "repo", "left_anti"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/list-{number}")
    for old in known[:-1]:
        fs.delete(path(f"{folder}/list-{old}"), True)
    named = {r.part for n in (*known[-1:], number) for r in versions(spark, folder, n).select("part").distinct().collect()}
    for name in [x.getPath().getName() for x in fs.listStatus(path(folder))]:
        if name.startswith("part-") and name not in named:
            fs.delete(path(f"{folder}/{name}"), True)


LISTED, LINE, VERSION, TREE = range(4)
COLUMNS = ("repo", "kind", "part", "id", "line", "commit", "is_binary", "lines", "sha", "path")


def _state_rows(batches):
    """Rows of a state from sorted rows (``COLUMNS``), a repository's list, lines, versions and trees one after the other."""
    repo = part = None
    texts, known, out, held = {}, {}, [], 0
    for b in batches:
        for name, kind, of, key, line, commit, binary, lines, sha, path in zip(*(column_values(b.column(c)) for c in COLUMNS)):
            if name != repo:
                repo, part, texts, known = name, None, {}, {}
            if kind == LISTED:
                part = of
            elif part is None or of != part:
                continue  # of another list
            elif kind == LINE:
                texts[key] = line
            elif kind == VERSION:
                ids, commits = lines or ((), ())
                if any(x not in texts for x in ids):
                    raise UnexpectedCheckpoint(f"{repo}: version {key} has a line that the state lacks")
                known[key] = Blame(commit, tuple(texts[x] for x in ids), commits, binary)
            else:
                if key not in known:
                    raise UnexpectedCheckpoint(f"{repo}: {sha} {path} has a version that the state lacks")
                out.append((repo, sha, path, known[key], True))
                held += len(known[key].lines)
                if held > 50_000 or len(out) > 2000:
                    yield blame_rows(out).drop_columns(["live"])
                    out, held = [], 0
    if out:
        yield blame_rows(out).drop_columns(["live"])


def read_state(spark: SparkSession, folder: str, expected: str | None = None, number: int | None = None, parts: int | None = None) -> DataFrame:
    """The rows that were written; all of version ``expected`` unless that is None.

    One shuffle by repository (into ``parts`` parts if given) brings the tables together, then a part streams its rows; it
    holds the state of one repository, as the fold that goes on from it does."""
    listed = versions(spark, folder, number)
    other = expected is not None and listed.filter(F.col("version") != expected).first()
    if other:
        raise UnexpectedCheckpoint(f"expected {expected}, found {other.version} for {other.repo}")
    written = [r.part for r in listed.select("part").distinct().collect()]
    kinds = {"part": "string", "id": "string", "line": "binary", "commit": "string", "is_binary": "boolean", "lines": TABLES["blames"].partition("lines ")[2], "sha": "string", "path": "string"}

    def of(kind: int, frame: DataFrame, **columns: str) -> DataFrame:
        return frame.select("repo", F.lit(kind).alias("kind"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    trees, blames, texts = (spark.read.schema(TABLES[t]).parquet(*[f"{folder}/{p}/{t}" for p in written]) for t in TABLES)
    rows = of(LISTED, listed, part="part").unionByName(of(LINE, texts, part="part", id="id", line="line"))
    rows = rows.unionByName(of(VERSION, blames, part="part", id="blame_id", commit="blame_commit", is_binary="is_binary", lines="lines"))
    rows = rows.unionByName(of(TREE, trees, part="part", id="blame_id", sha="sha", path="path"))
    apart = rows.repartition(parts, "repo") if parts else rows.repartition("repo")
    return apart.sortWithinPartitions("repo", "kind").select(*COLUMNS).mapInArrow(_state_rows, BLAME)
