"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only.

Systems that log a chat after every turn leave many conversations that are prefixes
of a longer one. Each turn gets a 128-bit hash of its place, role and text, and the
exclusive or of the hashes up to a turn identifies the prefix that ends there: a
rolling hash that a window computes. Conversations whose whole hash is another's
proper prefix are removed by an anti-join, equal ones are joined into the smallest
id, and the rest is rendered.

Hot groups: equal conversations and equal prefixes are reduced by aggregates that
combine before the shuffle; windows run within one conversation only.

Nulls and ties: turns are taken in order of turn, role and text, nulls first; a
null role or text differs from an empty one and is rendered as empty; rows without
a conv_id form one conversation; repeated rows are repeated turns; an empty table
gives no rows; texts of any length are hashed whole; other columns are ignored. A
conversation's turns are sorted in one task, as its rendered text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm._common import materialize, scratch

#: The text around a turn.
BEFORE_ROLE, AFTER_ROLE, AFTER_TURN = "<|", "|>\n", "<|end|>\n"


def _lane(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), n_turns and the hash (p1, p2) of the turns up to there."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(w))
    hashed = placed.select("conv_id", "place", _lane(1).alias("h1"), _lane(2).alias("h2"))
    upto = Window.partitionBy("conv_id").orderBy("place")
    return hashed.select("conv_id", "place", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"), F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one extends."""
    with scratch(turns.sparkSession, "chats") as kept:
        p = materialize(prefixes(turns), "prefixes")
        return kept(_maximal(p))


def _maximal(p: DataFrame) -> DataFrame:
    whole = p.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = p.where("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat, the rendered text, of every maximal conversation."""
    one = F.concat(F.lit(BEFORE_ROLE), F.coalesce("role", F.lit("")), F.lit(AFTER_ROLE), F.coalesce("text", F.lit("")), F.lit(AFTER_TURN))
    kept = maximal(turns).withColumnRenamed("conv_id", "_kept")
    rows = turns.select("conv_id", "turn", "role", "text", one.alias("said")).join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")))
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "said"))), lambda x: x["said"])
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.concat_ws("", said).alias("chat"))
