"""``python -m palimpsest code|branches|validate|dump FOLDER``"""

from __future__ import annotations

import argparse
import contextlib
import cProfile
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.engine import HistoryEngine, Options
from palimpsest.operators.metrics import dump
from palimpsest.operators.validate import differences
from palimpsest.sources.git import head_of
from palimpsest.sources.repos import find_repos


def totals(rows: DataFrame, folders: list[str], git: str) -> dict[str, int]:
    """Repositories, those without a commit, and the rows of each."""
    empty = sum(not head_of(git, d) for d in folders)
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos")).first()
    return {"repositories": len(folders), "without commits": empty, "with entries": counts.repos, "entries": counts.n}


def main(given: list[str] | None = None) -> int:
    """0, or 1 if there's no repository, lines differ or something fails."""
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("command", choices=("code", "branches", "validate", "dump"))
    parser.add_argument("folder")
    parser.add_argument("--sha", default="", help="start with this commit")
    parser.add_argument("--rows", type=int, default=1000, help="rows that are shown")
    parser.add_argument("--profile", default="", help="write where the driver's time goes to this file")
    parser.add_argument("--log", default="WARNING", help="least level of log lines")
    args = parser.parse_args(given)
    logging.basicConfig(level=args.log.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    folder = os.path.abspath(args.folder)
    folders = list(find_repos(folder))
    if not folders:
        print(f"no repository in {folder}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = HistoryEngine(spark, Options(folder, commit_from=args.sha, all_branches=args.command == "branches", strict_resume=False))
    profile = cProfile.Profile() if args.profile else None
    try:
        with profile or contextlib.nullcontext():
            rows = {"code": lambda: engine.code().drop("lines"), "branches": engine.branches, "validate": lambda: differences(engine), "dump": lambda: dump(engine.blame())}[args.command]()
            rows.show(args.rows, truncate=False)
            found = totals(rows, folders, engine.options.git)
    except Exception as error:  # noqa: BLE001 - told, and the exit code says so
        print(f"failed: {error}", file=sys.stderr)
        return 1
    finally:
        if profile:
            profile.dump_stats(args.profile)
    print(", ".join(f"{k}: {n}" for k, n in found.items()))
    for step, calls, seconds in engine.times.report():
        print(f"{step}: {calls} x, {seconds:.2f} s")
    return int(args.command == "validate" and found["entries"] > 0)


if __name__ == "__main__":
    sys.exit(main())
