"""Chat formatting: cumulative snapshots collapse, maximal conversations are rendered.

Native: DataFrame and SQL functions only.

Logs often hold a conversation several times, each snapshot with some more turns. Every
turn gets the rolling hash of its conversation's turns so far (role and text of each at
its place, 128 bits); a conversation whose last hash is found, at the same length, as an
inner hash of another one is a prefix of it. An anti-join keeps the conversations that are
nobody's prefix; of equal ones the smallest conv_id stays. Only these are rendered.

Scale: places and rolling sums come from one range partitioning by (conv_id, turn, role,
text) with offsets per (conversation, partition), so a conversation with a third of all
rows is ordered and hashed by many tasks. The two sides of the anti-join are aggregated to
distinct (length, hash) keys first: a first turn that a third of all conversations share
is one row. Rendering brings together the turns of one kept conversation, which are
returned as one row anyway.

Defined results: exactly repeated rows are one turn; turns are ordered by (turn, role,
text), nulls first, and a tie in ``turn`` is two turns; a null role or text is rendered
empty and differs from an empty one; rows with a null conv_id are one conversation; texts are taken whole at any length; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import segment
from tidemark.session import materialize

LANES = ("a", "b", "c", "d")


def _term(place: str):
    """Four 32-bit lanes of a turn's hash at its place; their running sums stay exact in 64 bits."""
    marked = [F.col("turn_role").isNull(), F.col("turn_text").isNull()]
    h = [F.xxhash64(F.lit(seed), place, "turn_role", "turn_text", *marked) for seed in (1, 2)]
    low = F.lit(0xFFFFFFFF)
    return {"a": F.shiftrightunsigned(h[0], 32), "b": h[0].bitwiseAND(low), "c": F.shiftrightunsigned(h[1], 32), "d": h[1].bitwiseAND(low)}


def rolling(turns: DataFrame) -> DataFrame:
    """(conv, place, a, b, c, d): each turn's 1-based place and the rolling hash up to it."""
    order = [F.col(c).asc_nulls_first() for c in ("turn_no", "turn_role", "turn_text")]
    tagged = segment(turns, ["conv"], order)  # written out; "_pid" and "_mono" are fixed from here on
    first = tagged.groupBy("conv", "_pid").agg(F.min("_mono").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(F.col("conv").alias("of"), F.col("_pid").alias("part"), "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = (tagged.join(first, tagged["conv"].eqNullSafe(first["of"]) & (tagged["_pid"] == first["part"]))
              .withColumn("place", F.col("_before") + F.col("_mono") - F.col("_from") + 1)
              .select("conv", "_pid", "place", *(v.alias(k) for k, v in _term("place").items())))
    here = Window.partitionBy("conv", "_pid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(placed.select("conv", "_pid", "place", *(F.sum(k).over(here).alias(k) for k in LANES)))
    sums = placed.groupBy("conv", "_pid").agg(*(F.max_by(k, "place").alias(k) for k in LANES))
    sums = sums.select(F.col("conv").alias("of"), F.col("_pid").alias("part"),
                       *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}0") for k in LANES))
    return placed.join(sums, placed["conv"].eqNullSafe(sums["of"]) & (placed["_pid"] == sums["part"])).select(
        "conv", "place", *((F.col(k) + F.col(f"{k}0")).alias(k) for k in LANES))


def maximal_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies): the conversations that are no prefix of a longer one, one of equal ones."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn_no"), F.col(role_col).alias("turn_role"),
                      F.col(text_col).alias("turn_text")).distinct()
    prefixes = materialize(rolling(turns))
    whole = prefixes.groupBy("conv").agg(F.max_by(F.struct("place", *LANES), "place").alias("end")).select("conv", "end.*")
    ends = whole.groupBy("place", *LANES).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    lengths = whole.select(F.col("conv").alias("of"), F.col("place").alias("n_turns"))
    inner = (prefixes.join(lengths, prefixes["conv"].eqNullSafe(lengths["of"])).where(F.col("place") < F.col("n_turns"))
             .select("place", *LANES).distinct())
    return ends.join(inner, ["place", *LANES], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 start: str = "<|", middle: str = "|>\n", end: str = "\n") -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): the maximal conversations, each turn as ``start role middle text end``."""
    kept = materialize(maximal_conversations(df, conv_col, turn_col, role_col, text_col))
    turns = df.select(F.col(conv_col).alias("of"), F.struct(F.col(turn_col).alias("no"), F.col(role_col).alias("role"),
                                                            F.col(text_col).alias("text")).alias("t")).distinct()
    parts = kept.join(turns, kept["conv"].eqNullSafe(turns["of"])).groupBy("conv", "n_turns", "n_copies").agg(
        F.sort_array(F.collect_list("t")).alias("ts"))
    chat = F.array_join(F.transform("ts", lambda t: F.concat(
        F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(end))), "")
    return parts.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", chat.alias("chat"))
