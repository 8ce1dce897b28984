"""Lines of commit logs, graphs and refs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_MODES = r"^100(?:644|755)$"


def clean_path(path: Column) -> Column:
    """Without empty and single-dot parts, as a join of path parts gives it."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), "/")


def numstat_path(path: Column) -> Column:
    """The new name of a path that may be a rename: ``a/{b => c}/d`` or ``a => b``."""
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    part = lambda i: F.regexp_extract(path, braces, i)
    joined = clean_path(F.concat_ws("/", part(1), part(3), part(4)))
    halves = F.split(path, " => ")
    return F.when(path.rlike(braces), joined).when(F.size(halves) > 1, F.get(halves, F.lit(1))).otherwise(path)


def status_name(action: Column) -> Column:
    """added, removed or modified; anything else is an error."""
    known = F.when(action == "A", "added").when(action == "D", "removed").when(action.isin("M", "R", "C", "MM", "T"), "modified")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown file status: "), action)))


def raw_files(line: Column) -> Column:
    """The files that a raw line ``:mode mode sha sha A<tab>path..`` tells of, as an
    array: two of a rename, none of what is neither a file nor a deletion."""
    head, paths = F.get(F.split(line, "\t"), F.lit(0)), F.slice(F.split(line, "\t"), 2, 3)
    words = F.split(head, " ")
    mode, action = F.get(words, F.lit(1)), F.get(words, F.lit(4))
    first, second = F.ltrim(F.get(paths, F.lit(0))), F.ltrim(F.get(paths, F.lit(1)))
    none, no = F.lit(None).cast("string"), F.lit(False)

    def file(name, status, renamed=no, copied=no, old=none, new=none, source=none) -> Column:
        parts = {"filename": name, "status": status, "renamed": renamed, "copied": copied, "renamed_from": old, "renamed_to": new, "copied_from": source}
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])

    moved = F.array(*[file(n, s, F.lit(True), no, first, second) for n, s in ((first, "removed"), (second, "added"))])
    copied = F.array(file(second, "added", no, F.lit(True), none, none, first))
    plain = F.array(file(first, status_name(action)))
    taken = mode.rlike(FILE_MODES) | (mode == "000000")
    empty = F.filter(plain, lambda x: F.lit(False))
    return F.when(~taken, empty).when((F.length(action) > 1) & action.startswith("R"), moved).when((F.length(action) > 1) & action.startswith("C"), copied).otherwise(plain)


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def author(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), email)


def bare_email(text: Column) -> Column:
    """What stands between angle brackets, and in square ones inside them."""
    inner = F.regexp_extract(text, "<(.*)>", 1)
    return F.when(inner.rlike(r"^\[.*\]$"), F.regexp_extract(inner, r"^\[(.*)\]$", 1)).otherwise(inner)


def zone_minutes(text: Column) -> Column:
    """Minutes east of UTC at the end of a date; Z is 0."""
    sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", i) for i in (1, 2, 3))
    value = hours.cast("int") * 60 + minutes.cast("int")
    return F.when(text.endswith("Z"), 0).when(sign == "-", -value).otherwise(value)


def git_time(text: Column) -> Column:
    """The instant of a date as git writes it (``Mon Jan 2 15:04:05 2006 -0700``) or as
    ISO 8601; null if it is neither."""
    month = F.map_from_arrays(F.array(*[F.lit(m) for m in MONTHS]), F.array(*[F.lit(f"{i + 1:02d}") for i in range(12)]))
    at = lambda i: F.regexp_extract(text, r"^\w{3} (\w{3}) +(\d{1,2}) (\d\d:\d\d:\d\d) (\d{4}) ([+-]\d\d)(\d\d)$", i)
    iso = F.concat(at(4), F.lit("-"), month[at(1)], F.lit("-"), F.lpad(at(2), 2, "0"), F.lit("T"), at(3), at(5), F.lit(":"), at(6))
    return F.try_to_timestamp(F.coalesce(F.when(at(4) != "", iso), text))


def graph_line(line: Column) -> tuple[Column, Column]:
    """(sha, parents) of ``sha@parent parent``."""
    parents = F.filter(F.split(F.substring_index(line, "@", -1), " "), lambda x: x != "")
    return F.substring_index(line, "@", 1), parents


def ref_line(line: Column) -> tuple[Column, Column, Column]:
    """(name, sha, date) of ``name@@@sha@@@date``; a detached head and HEAD have a null name."""
    parts = F.split(line, "@@@", 3)
    name = F.regexp_replace(F.get(parts, F.lit(0)), "^origin/", "")
    return F.when(~F.get(parts, F.lit(0)).startswith("(HEAD detached") & (name != "HEAD"), name), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
