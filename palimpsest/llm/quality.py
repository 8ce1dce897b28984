"""Operator 3, quality rules with thresholds that follow each language and source.

Every document gets four whole numbers, the higher the worse. For each language
and source a sketch counts their values in buckets of at most 1/32 relative
width; sketches merge by adding counts, so that those of a language, and that of all
documents, come from the same counts. The threshold is a fence above the
sketch's quartiles on the scale of square roots, on which counts spread alike whatever their size.
It moves with what is usual in the group, no value of it is given beforehand, and documents
within it stay, however many those are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import small_side, stash

#: In thousandths: signs that aren't letters, digits or white space, capitals, words
#: that repeat the one before, and how far the vocabulary lags behind the number of words.
METRICS = ("signs", "capitals", "echoes", "sameness")
SPREADS = 3
SIGNS = r"[^\p{L}\p{M}\p{N} \t\n\r]"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda x: x != "")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Thousandths, with a constant added to the length so that one sign or word
    doesn't decide over a short text; ``sameness`` is 1 less Herdan's C, the logarithm of the number
    of different words over that of all words."""
    length = F.length(text)

    def share(count: Column, of: Column, added: int) -> Column:
        return F.floor(count * 1000 / (of + added)).cast("bigint")

    # one pass over the words: the last one, and how many were the same as that before
    seen = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + (x == a["last"]).cast("int")).alias("n"))
    echoes = F.aggregate(words, seen, step, lambda a: a["n"])
    return {
        "signs": share(length - F.length(F.regexp_replace(text, SIGNS, "")), length, 100),
        "capitals": share(length - F.length(F.regexp_replace(text, CAPITALS, "")), length, 100),
        "echoes": share(echoes, F.size(words), 20),
        "sameness": F.round((1 - F.log(F.size(F.array_distinct(words)) + F.lit(10.0)) / F.log(F.size(words) + F.lit(10.0))) * 1000).cast("bigint"),
    }


def bucket(value: Column) -> Column:
    """The least value of the bucket: values below 64 are exact, above that
    the leading six binary digits count."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.element_at(F.array(*[F.lit(1 << i).cast("bigint") for i in range(57)]), low + 1)
    return value - value % width


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n) of rows that have the metrics as columns.
    Sketches of parts of a table, added up, are the sketch of the whole."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("m")
    return rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), one).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by.., metric, q3, spread, above) of the sketches merged by these columns: the upper
    quartile, how far the quartiles' square roots are apart, and how far from it
    that of the median of what exceeds it is, if anything does."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    at = merged.select(*by, "metric", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("c"), F.sum("n").over(group).alias("t"))
    quarter = lambda k: F.min(F.when(F.col("c") * 4 >= F.col("t") * k, F.col("bucket"))).over(group)
    at = at.withColumn("q1", quarter(1)).withColumn("q3", quarter(3)).withColumn("c3", F.max(F.when(F.col("bucket") <= F.col("q3"), F.col("c"))).over(group))
    median = F.min(F.when((F.col("bucket") > F.col("q3")) & ((F.col("c") - F.col("c3")) * 2 >= F.col("t") - F.col("c3")), F.col("bucket")))
    found = at.groupBy(*by, "metric", "q1", "q3").agg(median.alias("median"))
    return found.select(*by, "metric", "q3", (F.sqrt("q3") - F.sqrt("q1")).alias("spread"), (F.sqrt("median") - F.sqrt("q3")).alias("above"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, one column for each metric): the square of the upper quartile's root plus
    three times the group's spread. Where its quartiles agree, its language's spread counts; where
    those agree too, as with a metric that is nothing in most documents, the distance from
    them to the median of the language's values above."""
    own, lang = quartiles(sketch, "lang", "source"), quartiles(sketch, "lang")
    lang = lang.select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("spread").alias("wide"), "above")
    joined = own.drop("above").join(small_side(stash(lang, "languages")), own.lang.eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")))
    spread = F.when(F.col("spread") > 0, F.col("spread")).when(F.col("wide") > 0, F.col("wide")).otherwise(F.coalesce("above", F.lit(0.0)))
    root = F.sqrt("q3") + SPREADS * spread
    fence = joined.select("lang", "source", "metric", F.floor(root * root).alias("fence"))
    return fence.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(m) for m in METRICS])


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, kept: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """The rows that have a word with their metrics, measured once and written; the
    thresholds; and which rows belong to which and keep within them. ``row`` holds the columns ``kept``."""
    packed = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("q_text"), docs[lang_col].alias("q_lang"), docs[source_col].alias("q_source"))
    split = packed.withColumn("q_words", words_of(F.col("q_text"))).filter(F.size("q_words") > 0)
    rows = stash(split.select("row", "q_lang", "q_source", *[v.alias(m) for m, v in measures(F.col("q_text"), F.col("q_words")).items()]), "measured")
    limits = small_side(stash(thresholds(stash(sketches(rows, "q_lang", "q_source"), "quantiles")), "thresholds"))
    rules = [rows.q_lang.eqNullSafe(limits.lang), rows.q_source.eqNullSafe(limits.source), *[rows[m] <= limits[m] for m in METRICS]]
    return rows, limits, reduce(lambda a, b: a & b, rules)


def filter_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that keep within all thresholds of their group.

    Null languages and sources are groups of their own. Null and empty texts and
    those of white space go; long texts are measured whole; repeated rows have
    one fate, and a value equal to the threshold stays. Columns may have any
    names. An empty table stays empty.
    """
    rows, limits, good = _judged(docs, text_col, lang_col, source_col, docs.columns)
    return rows.join(limits, good, "left_semi").select("row.*")


def kept_with_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, each metric, each threshold) of the rows that stay, as
    ``filter_documents`` says."""
    rows, limits, good = _judged(docs, text_col, lang_col, source_col, [id_col])
    return rows.join(limits, good).select(rows.row[id_col].alias("doc_id"), rows.q_lang.alias("lang"), rows.q_source.alias("source"), *[rows[m].alias(m) for m in METRICS], *[limits[m].alias(f"{m}_limit") for m in METRICS])


def quality_sql() -> str:
    share = lambda count, of, added: f"CAST(floor(({count}) * 1000 / (({of}) + {added})) AS BIGINT)"
    bucketed = "v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0))"
    quartiles = lambda by: f"""SELECT {by}metric, q3, sqrt(q3) - sqrt(q1) AS spread, sqrt(min(CASE WHEN b > q3 AND (c - c3) * 2 >= t - c3 THEN b END)) - sqrt(q3) AS above
  FROM (SELECT *, max(CASE WHEN b <= q3 THEN c END) OVER (PARTITION BY {by}metric) AS c3
    FROM (SELECT *, min(CASE WHEN c * 4 >= t THEN b END) OVER (PARTITION BY {by}metric) AS q1, min(CASE WHEN c * 4 >= t * 3 THEN b END) OVER (PARTITION BY {by}metric) AS q3
      FROM (SELECT {by}metric, b, sum(sum(n)) OVER (PARTITION BY {by}metric ORDER BY b) AS c, sum(sum(n)) OVER (PARTITION BY {by}metric) AS t FROM s GROUP BY {by}metric, b)))
  GROUP BY {by}metric, q1, q3"""  # noqa: E731
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, text, length(text) AS len, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
m AS (
  SELECT doc_id, lang, source,
         {share(f"len - length(regexp_replace(text, '{SIGNS}', '', 'g'))", "len", 100)} AS signs,
         {share(f"len - length(regexp_replace(text, '{CAPITALS}', '', 'g'))", "len", 100)} AS capitals,
         {share("len(list_filter(list_zip(ws[2:], ws[:-2]), lambda x: x[1] = x[2]))", "len(ws)", 20)} AS echoes,
         CAST(round((1 - ln(len(list_distinct(ws)) + 10.0::DOUBLE) / ln(len(ws) + 10.0::DOUBLE)) * 1000) AS BIGINT) AS sameness
  FROM w WHERE len(ws) > 0),
u AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS metric, {x} AS v FROM m" for x in METRICS)}),
s AS (SELECT lang, source, metric, {bucketed} AS b, count(*) AS n FROM u GROUP BY ALL),
own AS ({quartiles("lang, source, ")}), per_lang AS ({quartiles("lang, ")}),
f AS (
  SELECT o.lang, o.source, o.metric, sqrt(o.q3) + {SPREADS} * CASE WHEN o.spread > 0 THEN o.spread WHEN p.spread > 0 THEN p.spread ELSE coalesce(p.above, 0) END AS root
  FROM own o JOIN per_lang p ON o.lang IS NOT DISTINCT FROM p.lang AND o.metric = p.metric),
l AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{x}' THEN CAST(floor(root * root) AS BIGINT) END) AS {x}_limit" for x in METRICS)} FROM f GROUP BY ALL)
SELECT m.doc_id, m.lang, m.source, {", ".join(f"m.{x}" for x in METRICS)}, {", ".join(f"{x}_limit" for x in METRICS)}
FROM m JOIN l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
WHERE {" AND ".join(f"m.{x} <= {x}_limit" for x in METRICS)}"""
