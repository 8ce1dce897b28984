"""Operator 10, mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern; the flow routes each pattern's tokens to the quotas of its sources,
where the r-th use of a token costs r * r, so that documents repeat only where
quotas can't be met otherwise. The documents that a pattern contributes are
taken in a seeded order until their tokens reach its flow.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import small_side, stash

#: Uses of a token at most; the cost of a token that no document can give.
REPEATS, SHORT = 4, 10_000
BUCKETS = 1 << 16
#: What languages and sources get of the budget together, and how far each one's
#: share follows its size (0: all the same, 1: in proportion).
FAMILIES, POWER = {"lang": 0.8, "source": 0.2}, 0.3


class Plan(NamedTuple):
    flows: dict[tuple[str, str], int]  # (pattern, source): tokens
    short: dict[str, int]  # source: tokens of its quota that nothing can fill
    cost: int
    quotas: dict[str, int]


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], start: int, end: int, amount: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a cheapest flow of
    ``amount``: successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, price = [], [], []
    for a, b, capacity, cost in arcs:
        for x, y, r, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)
    potential = [0] * n
    while amount:
        far, via, heap = [None] * n, [-1] * n, [(0, start)]
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                y, nd = to[e], d + price[e] + potential[x] - potential[to[e]]
                if room[e] and (far[y] is None or nd < far[y]):
                    far[y], via[y] = nd, e
                    heapq.heappush(heap, (nd, y))
        if far[end] is None:
            raise ValueError("no flow of that amount")
        potential = [p + (d if d is not None else 0) for p, d in zip(potential, far)]
        path, y, step = [], end, amount
        while y != start:
            path.append(via[y])
            step = min(step, room[via[y]])
            y = to[via[y] ^ 1]
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
        amount -= step
    return [room[2 * i + 1] for i in range(len(arcs))]


def plan_flow(patterns: dict[str, tuple[list[str], int]], quotas: dict[str, int], repeats: int = REPEATS) -> Plan:
    """patterns: name to (its sources, tokens). What no pattern can give a quota
    is reported as short."""
    names, sources = sorted(patterns), sorted(quotas)
    node = {("p", p): i + 2 for i, p in enumerate(names)} | {("s", s): i + 2 + len(names) for i, s in enumerate(sources)}
    arcs, kinds = [], []
    for p in names:
        members, tokens = patterns[p]
        for r in range(1, repeats + 1):
            arcs.append((0, node["p", p], tokens, r * r))
            kinds.append(None)
        for s in sorted({*members} & {*quotas}):
            arcs.append((node["p", p], node["s", s], repeats * tokens, 0))
            kinds.append((p, s))
    for s in sources:
        arcs += [(0, node["s", s], quotas[s], SHORT), (node["s", s], 1, quotas[s], 0)]
        kinds += [s, None]
    flow = min_cost_flow(len(names) + len(sources) + 2, arcs, 0, 1, sum(quotas.values()))
    flows = {k: f for k, f in zip(kinds, flow) if isinstance(k, tuple) and f}
    return Plan(flows, {k: f for k, f in zip(kinds, flow) if isinstance(k, str) and f}, sum(f * a[3] for f, a in zip(flow, arcs)), quotas)


def tempered(patterns: dict[str, tuple[list[str], int]], budget: int, power: float = POWER, families: dict[str, float] | None = None) -> dict[str, int]:
    """Quotas that add up to ``budget``: each source weighs its tokens to ``power``
    within its family (the part of its name before the colon), and a family what
    ``families`` says, or 1; weights of families that occur are scaled to add up to one."""
    sizes: dict[str, dict[str, int]] = {}
    for members, tokens in patterns.values():
        for s in members:
            family = sizes.setdefault(s.partition(":")[0], {})
            family[s] = family.get(s, 0) + tokens
    given = {k: (FAMILIES if families is None else families).get(k, 1) for k in sizes}
    weights = {s: given[k] / sum(given.values()) * n**power / sum(m**power for m in f.values() if m) for k, f in sizes.items() for s, n in f.items() if n}
    ends, total, out = 0, 0.0, {}
    for s in sorted(weights):
        total += weights[s]
        out[s] = round(budget * min(1.0, total)) - ends
        ends += out[s]
    return out


def default_sources(lang: str = "lang", source: str = "source") -> Column:
    """A document belongs to the source it came from and to that of its language."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(c).cast("string"), F.lit("?")))
    return F.array(name("lang", lang), name("source", source))


def token_count(text: Column) -> Column:
    """Tokens at four UTF-8 bytes each, rounded up; null and empty texts have none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("bigint")


def select_documents(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, power: float = POWER, families: dict[str, float] | None = None, repeats: int = REPEATS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None) -> tuple[DataFrame, Plan]:
    """(row, doc_id, pattern, n_tokens, copies) of the rows that are used, and the plan.

    ``row`` is the whole row as a struct, ``copies`` how often it is used.
    ``budget`` is in parts of all tokens; ``weights`` gives each source's share of
    it (they are scaled to add up to one), by default ``tempered`` ones. No token is
    used more than ``repeats`` times; what quotas lack then is in the plan's ``short``.
    A pattern with flow f over t tokens uses each of its rows f // t times, and once more
    those whose predecessors in the seeded order have fewer than f % t tokens. The
    order goes by two hashes of seed, id and text; rows of one id and text
    follow each other. Null sources are named ``?``. Rows without text have no
    tokens, so they aren't used. No rows, or none with tokens, give no rows. Only the
    patterns' totals reach the driver.
    """
    spark = docs.sparkSession
    sources = F.array_sort(F.array_distinct(sources if sources is not None else default_sources()))
    text, name = docs[text_col], docs[id_col].cast("string")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), F.array_join(sources, "\x1f").alias("pattern"),
        token_count(text).alias("n_tokens"), F.xxhash64(F.lit(seed), name, text).alias("h"), F.xxhash64(text, F.lit(seed), name).alias("g"),
    ).filter("n_tokens > 0")
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    sums = stash(rows.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n")), "buckets")
    patterns = {r.pattern: (r.pattern.split("\x1f"), r.n) for r in sums.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for _, n in patterns.values())
    if weights is None:
        quotas = tempered(patterns, round(total * budget), power, families)
    else:
        quotas = {s: round(total * budget * w / sum(weights.values())) for s, w in weights.items()}
    plan = plan_flow(patterns, quotas, repeats)
    used: dict[str, int] = {}
    for (p, _), f in plan.flows.items():
        used[p] = used.get(p, 0) + f
    made = [(p, used.get(p, 0) // n, used.get(p, 0) % n) for p, (_, n) in patterns.items()]
    limits = stash(spark.createDataFrame(made, "pattern string, full bigint, rest bigint"), "limits")
    # the bucket in which a pattern's rest ends, then the row, of narrow rows only
    reached = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket"))
    cut = sums.withColumn("before", reached - F.col("n")).join(small_side(limits), "pattern").filter("before < rest AND before + n >= rest")
    cut = stash(cut.select("pattern", F.col("bucket").alias("cut"), "before", "rest"), "cuts")
    near = rows.select("pattern", "bucket", "h", "g", "n_tokens").join(small_side(cut).withColumnRenamed("cut", "bucket"), ["pattern", "bucket"])
    each = near.groupBy("pattern", "bucket", "before", "rest", "h", "g", "n_tokens").agg((F.count("*") * F.col("n_tokens")).alias("n"))
    reached = F.sum("n").over(Window.partitionBy("pattern").orderBy("h", "g", "n_tokens"))
    last = each.withColumn("before", F.col("before") + reached - F.col("n")).filter("before < rest AND before + n >= rest")
    last = stash(last.select("pattern", F.struct("bucket", "h", "g").alias("last"), F.ceil((F.col("rest") - F.col("before")) / F.col("n_tokens")).alias("times")), "last")
    at = stash(limits.join(small_side(last), "pattern", "left"), "limits")  # without a rest there is no last one
    known = rows.join(small_side(at), "pattern").withColumn("place", F.struct("bucket", "h", "g"))
    is_last = F.coalesce(F.col("place") == F.col("last"), F.lit(False))
    others = known.filter(~is_last).withColumn("copies", F.col("full") + F.coalesce((F.col("place") < F.col("last")).cast("bigint"), F.lit(0)))
    order = Window.partitionBy("pattern").orderBy(F.to_json("row"))  # only rows of one id and text
    equal = known.filter(is_last).withColumn("copies", F.col("full") + (F.row_number().over(order) <= F.col("times")).cast("bigint"))
    kept = [x.filter("copies > 0").select("row", "doc_id", "pattern", "n_tokens", "copies") for x in (others, equal)]
    return kept[0].unionByName(kept[1]), plan


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, pattern, n_tokens, copies), as ``select_documents`` says, and a row
    with a null doc_id, no copies, and ``short:`` and its name as the pattern for each
    source whose quota lacks ``n_tokens`` that its documents can't give."""
    rows, plan = select_documents(docs, **options)
    rows = rows.select("doc_id", F.translate("pattern", "\x1f", "+").alias("pattern"), "n_tokens", "copies")
    lacking = [(None, f"short:{s}", n, 0) for s, n in sorted(plan.short.items())]
    return rows.unionByName(docs.sparkSession.createDataFrame(lacking, rows.schema)) if lacking else rows


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as it is used."""
    rows = select_documents(docs, **options)[0]
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
