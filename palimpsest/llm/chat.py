"""Operator 4, chat formatting after the collapse of cumulative snapshots.

Logs hold a conversation again each time it grew. Each turn's prefix gets a
rolling 128-bit hash; a conversation whose whole hash is the hash of a proper
prefix of another one is dropped by an anti-join, and of equal conversations one
stays. What remains is rendered as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import small_side, stash

START, END = "<|im_start|>", "<|im_end|>"


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, said array<struct<turn, r, role, t, text>>): each conversation's
    turns in order; ``r`` and ``t`` say whether role and text are there. The
    only shuffle of texts."""
    said = F.struct("turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("t"), "text")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("said"))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, n) of ``gathered`` rows: the hash of each conversation's first ``pos``
    turns, a running sum of hashes that each hold the turn's place; ``n`` turns in all.
    A null counts as another thing than any text."""
    parts = lambda x: (x.r, F.coalesce(x.role, F.lit("")), x.t, F.coalesce(x.text, F.lit("")))
    hashes = F.transform("said", lambda x: F.struct(F.xxhash64(*parts(x)).alias("a"), F.xxhash64(F.lit(7), *reversed(parts(x))).alias("b")))
    placed = conversations.select("conv_id", F.size("said").cast("bigint").alias("n"), F.posexplode(hashes).alias("at", "h")).select("conv_id", "n", (F.col("at") + 1).alias("pos"), "h.a", "h.b")
    running = Window.partitionBy("conv_id").orderBy("pos")
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)")).over(running).cast("decimal(38,0)")
    out = placed.withColumn("h1", total("pos", "a", "b")).withColumn("h2", total(F.lit(11), "b", "pos", "a"))
    return out.select("conv_id", "pos", "h1", "h2", "n")


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n) of ``gathered`` rows: conversations that aren't a proper prefix of another one;
    of equal ones that with the smallest id."""
    hashed = prefix_hashes(conversations)
    whole = hashed.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = hashed.filter("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("bigint").alias("n"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of ``gathered`` rows."""
    one = lambda x: F.concat(F.lit(START), F.coalesce(x.role, F.lit("unknown")), F.lit("\n"), F.coalesce(x.text, F.lit("")), F.lit(END + "\n"))
    return conversations.select("conv_id", F.size("said").cast("bigint").alias("n_turns"), F.array_join(F.transform("said", one), "").alias("chat"))


def collapse_and_render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, chat), a row for each maximal conversation.

    Turns go by their number, on ties by role, then by text, nulls first in each; gaps
    don't count. Two conversations are equal if role and text are, turn by turn;
    a null role or text equals only another null, and is rendered as
    ``unknown`` or as nothing. Rows without a conversation id are no conversation
    and go. A repeated row is another turn. Long turns stay whole; other columns,
    whatever their names, aren't read; no rows give no rows.
    """
    named = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    turns = conversations.select(*[F.col(c).alias(a) for a, c in named.items()]).filter("conv_id IS NOT NULL")
    whole = stash(gathered(turns), "conversations")
    return render(whole.join(small_side(stash(maximal_conversations(whole), "maximal")), "conv_id", "left_semi"))


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
  WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT conv_id, pos, n, string_agg(length(coalesce(role, '-')) || ':' || coalesce(role, '-') || (role IS NULL) || length(coalesce(text, '-')) || ':' || coalesce(text, '-') || (text IS NULL), '')
         OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
k AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE pos = n AND NOT EXISTS (SELECT 1 FROM p AS q WHERE q.pos < q.n AND q.pos = p.pos AND q.prefix = p.prefix)
  GROUP BY prefix)
SELECT conv_id, count(*) AS n_turns,
       string_agg('{START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY pos) AS chat
FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id"""
