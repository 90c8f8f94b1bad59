"""Chat formatting: cumulative snapshots collapse to maximal conversations (operator 4); DataFrame functions only.

Logged conversations are often snapshots of one that grew.  Every turn has a hash of its position, role and
text; running sums of them are hashes of all turn prefixes, and a conversation whose hash is a prefix hash of a
longer one is dropped by an anti-join.  Turns are numbered and summed in two levels (chunks of ``CHUNK`` turn
numbers, then chunk totals), so that one very long conversation is spread over many tasks.  Numbered turns are written
once; prefixes are compared without texts, which are read again for the kept conversations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresift.llm.common import cut

CHUNK = 64
_KEYS = ("h1", "h2")


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, chunk, pos, role, text, p1, p2, rows, s1, s2)``: turns with positions and prefix hashes.

    ``rows``, ``s1`` and ``s2`` are the chunk's count and hash sums.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), text("role").alias("role"), text("text").alias("text")).distinct()
    turns = turns.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    turns = turns.withColumn("k", F.row_number().over(order))
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("skip", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    turns = turns.join(sizes, ["conv_id", "chunk"]).withColumn("pos", F.col("k") + F.col("skip"))
    for i, key in enumerate(_KEYS):
        turns = turns.withColumn(key, F.xxhash64(F.lit(i), "pos", "role", "text").cast("decimal(20,0)"))
    sums = turns.groupBy("conv_id", "chunk").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    base = sums.withColumn("b1", F.coalesce(F.sum("s1").over(before), F.lit(0))).withColumn("b2", F.coalesce(F.sum("s2").over(before), F.lit(0)))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.join(base, ["conv_id", "chunk"])
    return turns.select("conv_id", "chunk", "pos", "role", "text", "rows", "s1", "s2", *[(F.sum(h).over(run) + F.col(b)).cast("decimal(38,0)").alias(p) for h, b, p in (("h1", "b1", "p1"), ("h2", "b2", "p2"))])


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that no longer one starts with; of equal ones the least id."""
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by("p1", "pos").alias("p1"), F.max_by("p2", "pos").alias("p2"))
    reps = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = turns.join(reps.select("conv_id", "n_turns"), "conv_id").where("pos < n_turns").select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    return reps.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in chat markup; markup inside a text is broken up so that it can't end the turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, text)``: maximal conversations, rendered.

    Turns are ordered by turn (null first), role and text; repeated rows count once, null roles and texts as
    empty.  Turns without a conversation id belong to none and are left out; an empty table gives an
    empty result; extra columns are ignored.  A rendered conversation is one row, put together from its chunks, as long as it may be;
    turns of one number stand in one chunk.
    """
    turns = cut(numbered(conversations))
    kept = maximal(turns.select("conv_id", "pos", "p1", "p2"))
    parts = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("t")))).alias("ts"))
    parts = parts.select("conv_id", "n_turns", F.struct("chunk", F.concat_ws("", F.col("ts.t")).alias("t")).alias("part"))
    return parts.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list("part")).alias("ps")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("ps.t")).alias("text"))
