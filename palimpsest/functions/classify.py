"""Why a file isn't counted, and its language, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.exclusions import exclusion_pattern
from palimpsest.functions.languages import BY_ENDING, BY_NAME, BY_PROGRAM, SETTINGS

MOST_BYTES, MOST_LINES, MOST_WIDTH = 1_000_000, 40_000, 1096
LICENSE_PATH = r"(?:LICEN[CS]E|LICENSE-.*|UNLICEN[CS]E|COPYING|README)(?:\.(?:txt|md))?$"
SETTINGS_PATH = rf"\.(?:{'|'.join(sorted(e for e, n in BY_ENDING.items() if n in SETTINGS))})$"
DOT_PATH = r"(?:^|/)\.[^/]*$"
VENDOR_PATH = "|".join((
    r"(?:^|/)cache/", r"^[Dd]ependencies/", r"(?:^|/)dist/", r"^deps/", r"(?:^|/)(?:node_modules|bower_components|vendors?|extern(?:al)?)/",
    r"(?:3rd|[Tt]hird)[-_]?[Pp]arty/", r"(?:^|/)configure(?:\.ac)?$", r"(?:^|/)config\.(?:guess|sub)$", r"(?:^|/)jquery[^/]*\.js$",
    r"(?:^|/)bootstrap[^/.]*\.(?:js|css|less|scss|styl)$", r"(?:^|/)(?:normalize|font-?awesome)\.(?:css|less|scss)$", r"(?:^|/)Godeps/", r"\.min\.(?:js|css)$",
    r"(?:^|/)(?:angular|react|vue|d3|underscore|backbone)[^/]*\.min\.js$", r"^Pods/", r"(?:^|/)[Cc]arthage/", r"(?:^|/)gradlew?(?:\.bat)?$",
))
EXCLUDED_PATH = exclusion_pattern()
REMOVED, CONFIG, DOT, EXCLUDED, VENDORED = "File was removed", "File was a config file", "File was a dot file", "File was on an exclusion list", "File was a vendored file"
LICENSE, UNKNOWN, GENERATED = "File is a license file", "Language was unknown", "File was generated"


def path_reason(path: Column) -> Column:
    """The first rule that keeps a path out, or an empty string."""
    vendored = path.rlike(VENDOR_PATH) & ~path.startswith("src/")
    rules = ((path.rlike(SETTINGS_PATH), CONFIG), (path.rlike(DOT_PATH), DOT), (path.rlike(EXCLUDED_PATH), EXCLUDED), (vendored, VENDORED))
    out = F
    for rule, reason in rules:
        out = out.when(rule, F.lit(reason))
    return out.otherwise(F.lit(""))


def language(path: Column, first: Column | None = None) -> Column:
    """By the whole name, else by its ending, else by the program that the file's ``first``
    line calls, without its version; empty if none is known."""
    name = F.substring_index(path, "/", -1)
    ending = F.lower(F.when(name.contains("."), F.substring_index(name, ".", -1)))
    look = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    known = [look(BY_NAME, name), look(BY_ENDING, ending)]
    if first is not None:
        program = F.regexp_extract(first, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z][A-Za-z+_-]*)[\d.]*(?:\s|$)", 1)
        known.append(look(BY_PROGRAM, F.lower(program)))
    return F.coalesce(*known, F.lit(""))


def first_wide_line(lines: Column) -> Column:
    """The length in bytes of the first line beyond the limit, null if there's none."""
    return F.get(F.transform(F.filter(lines, lambda x: F.octet_length(x) > MOST_WIDTH), F.octet_length), F.lit(0))


def skip_reason(path: Column, size: Column, n_lines: Column, wide: Column, is_license: Column, first: Column | None = None) -> Column:
    """The whole cascade, in order: size, licence, path, lines, width, language."""
    by_path = path_reason(path)
    return (
        F.when(size > MOST_BYTES, F.format_string(f"File size was %dK which exceeds limit of {MOST_BYTES // 1000}K", F.floor(size / 1000).cast("bigint")))
        .when(is_license, LICENSE)
        .when(by_path != "", by_path)
        .when(n_lines > MOST_LINES, f"File has more than {MOST_LINES} lines")
        .when(wide.isNotNull(), F.format_string(f"File has a line width of %d which is greater than max of {MOST_WIDTH}", wide))
        .when(language(path, first) == "", UNKNOWN)
        .otherwise("")
    )
