"""Chat formatting: collapse cumulative snapshots of conversations, then render those that are left.

Each turn is hashed with its role; the running exclusive-or of hashes salted with the position names each
prefix of a conversation by 128 bits, and so each whole one. Of equal conversations the smallest id stays;
an anti-join against the prefixes of longer ones then leaves those that nothing continues. Equal turns meet
in partial aggregation, so a first turn or conversation that a third of all logs share moves once a task.

Defined cases: turns are ordered by number (null first), then by the md5 of role and text; null role or
text is empty; ``<|`` in either is rendered as ``< |``, so that no text can open or close a turn; rows without a conversation id belong to none and are left out; repeated rows are turns each;
an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import staged, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn() -> Column:
    role = F.coalesce("role", F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce("text", F.lit(""))))


def _inside(column: str) -> Column:
    """Text in which nothing reads as a marker."""
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("< |"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, last): the name of each conversation's first ``pos`` turns."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "th")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    out = turns.where("conv_id is not null").select("conv_id", "turn", _turn().alias("th"))
    out = out.withColumn("pos", F.row_number().over(order)).withColumn("last", F.lead("pos").over(order).isNull())
    hashed = [F.bit_xor(F.xxhash64(F.lit(salt), "pos", "th")).over(running).alias(f"h{salt}") for salt in (1, 2)]
    return out.select("conv_id", "pos", "last", *hashed)


def maximal(turns: DataFrame) -> DataFrame:
    """The ids of the conversations that are no prefix of another, with their number of turns and of copies."""
    every = staged(prefixes(turns), "turn-prefixes")
    whole = every.where("last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = every.where("not last").select("pos", "h1", "h2").distinct()
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """A row for each conversation that is left: its chat text. Other columns of ``turns`` are not read."""
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = maximal(turns)
    part = F.struct("turn", _turn().alias("th"), F.concat(F.lit(OPEN), _inside("role"), F.lit("\n"), _inside("text"), F.lit(f"{CLOSE}\n")).alias("part"))
    # nulls come first in the order of structs, as in prefixes()
    chats = turns.join(keep, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return chats.select("conv_id", "n_turns", "n_copies", F.array_join("parts.part", "").alias("chat"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP2_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS th
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(th, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, th ROWS UNBOUNDED PRECEDING) AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, th)),
whole AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY pre),
kept AS (SELECT * FROM whole WHERE pre NOT IN (SELECT pre FROM p WHERE pos < n))
SELECT conv_id, count(*) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10), '' ORDER BY pos) AS chat
FROM p JOIN kept USING (conv_id) GROUP BY conv_id
"""
