"""Chat formatting after cumulative-snapshot collapse.

A log that stores a conversation again after each turn holds every earlier state as a prefix. Each turn gets a rolling
hash of all turns up to it: a running sum of digests that include the position, so it is an ordinary window sum. A
conversation whose last hash occurs inside a longer one is a snapshot of it; an anti join drops those, and of equal
conversations the smallest conv_id stays. DataFrame functions only.

Positions and running sums are computed within blocks of turn numbers and shifted by the totals of earlier blocks, so
a conversation that holds much of the table is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
ROLES = ("system", "user", "assistant")
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _running(df: DataFrame, value: Column, order: list, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a conversation up to each row, by blocks."""
    df = df.withColumn("_v", value)
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy("conv_id", "block").agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("conv_id", "block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_s"))
    local = df.withColumn("_l", F.sum("_v").over(inside)).join(shifts, ["conv_id", "block"])
    return local.withColumn(name, F.col("_l") + F.col("_s")).drop("_v", "_l", "_s")


def _digest_part(first: int) -> Column:
    packed = F.sha2(F.concat_ws("\x1f", "position", "role", "text"), 256)
    return F.conv(F.substring(packed, first, 15), 16, 10).cast("decimal(38,0)")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 1, role, text and the rolling hashes ``h1`` and ``h2`` up to each turn.

    Rows repeating a whole turn count once; different rows of one turn number follow each other by role and text. A
    null turn comes first, a null role counts as ``user`` and a null text as empty. Rows without conv_id belong to no
    conversation and are left out.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("conv_id is not null").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = _running(rows, F.lit(1).cast("long"), order, "position")
    rows = _running(rows, _digest_part(1), order, "h1")
    rows = _running(rows, _digest_part(17), order, "h2")
    return rows.select("conv_id", "position", "role", "text", "h1", "h2")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that are no prefix of a longer one, equal ones once."""
    last = turns.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    # One row per position stands for all conversations that begin alike up to it.
    states = turns.select("conv_id", "position", "h1", "h2").join(last, "conv_id")
    whole = states.where("position = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = states.where("position < n_turns").select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def render(turns: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and run of ``block`` turns: conv_id, part from 0, n_turns, copies, text.

    Markers inside a turn are broken by a backslash. Parts joined in order are the whole conversation, so that no
    single row holds an unbounded one.
    """
    def safe(c: Column) -> Column:
        return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", r"<\\|$1|>")

    line = F.concat(F.lit(BEGIN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(END + "\n"))
    rows = turns.join(kept, "conv_id").select("conv_id", "n_turns", "copies", F.floor((F.col("position") - 1) / block).cast("long").alias("part"), "position", line.alias("line"))
    parts = rows.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join("lines.line", "").alias("text"))


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    turns = turns_of(conversations)
    return render(turns, maximal_conversations(turns), block)
