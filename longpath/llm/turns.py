"""Conversations as ordered turns, numbered without gathering one in a task.

Rows are dealt to ranges of (conversation, turn), within which they are sorted and numbered; how many rows of a conversation the ranges
before hold is summed over a row a conversation and range. So a conversation of a third of all rows is spread over tasks like any
other third of the rows. Null turns come first; turns of equal number are ordered by the digest of role and text, so the order is a
function of the rows. Null roles and texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longpath.llm.common import stored

WORDS = r"[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    """The first 16 bytes of SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)), 1, 16)


def numbered(turns: DataFrame, *columns: Column) -> DataFrame:
    """conv_id, pos (0, 1, ... within the conversation), digest and the given columns of each row of turns (conv_id, turn, role, text)."""
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), *columns)
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    at = F.monotonically_increasing_id()  # the number of the range above, the place in it below
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").withColumn("at", at), "turns")
    placed = placed.withColumn("range", F.shiftright("at", 33).cast("int")).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    held = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    held = held.select(F.col("conv_id").alias("of"), F.col("range").alias("in"), (before - F.col("first")).alias("shift"))
    out = placed.join(held, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("of", "in", "shift", "at", "range")
