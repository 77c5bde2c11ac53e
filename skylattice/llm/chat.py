"""Chat formatting: logged snapshots collapse into maximal conversations, which are then rendered.

A chat log often stores every state of a growing conversation. Each turn gets the rolling hash of
the turns up to it; a conversation whose whole hash is the hash of a proper prefix of a longer one
is a snapshot and goes, and of equal conversations the smallest conv_id stays. Prefix hashes and
whole hashes are made unique before they meet, so a first turn or a conversation that a third of
the log shares costs one row. DataFrame operations only.

The rolling hash of turn k is the XOR of two 64-bit hashes of (i, role, text) for i up to k:
the position is hashed too, so order counts, and 128 bits make chance equality negligible.

Defined results: turns are ordered by turn, then role, then text, nulls first; a row that repeats
the one before it whole is dropped; a null role or text differs from an empty one when hashed and
renders as empty; rows without conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk

TURN = ("<|im_start|>", "\n", "<|im_end|>\n")
SEEDS = (0x5EED, 0xFACE)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): turns numbered from 1, without repeated rows."""
    rows = tk.only(conversations, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    here, before = F.struct("turn", "role", "text"), F.lag(F.struct("turn", "role", "text")).over(order)
    fresh = rows.withColumn("repeats", before.isNotNull() & here.eqNullSafe(before)).where("not repeats")
    return fresh.select("conv_id", F.row_number().over(order).alias("at"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, at, h1, h2, n_turns): the rolling hash of the turns up to each."""
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = [F.col(c).isNull() for c in ("role", "text")]
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text", *known)).over(so_far) for seed in SEEDS]
    return turns.select("conv_id", "at", rolling[0].alias("h1"), rolling[1].alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of conversations that no longer one begins with; one of equal ones stays."""
    hashes = prefix_hashes(turns)
    key = ["at", "h1", "h2"]
    inner = hashes.where("at < n_turns").select(*key).distinct()
    whole = hashes.where("at = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(inner, key, "left_anti").select("conv_id", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    none = F.lit("")
    return F.concat(F.lit(TURN[0]), F.coalesce(role, none), F.lit(TURN[1]), F.coalesce(text, none), F.lit(TURN[2]))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    turns = ordered_turns(conversations)
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("kept_id"), "n_copies")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    parts = F.array_sort(F.collect_list(F.struct("at", rendered(F.col("role"), F.col("text")).alias("turn"))))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(parts, lambda x: x["turn"]), "").alias("rendered"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(tk.table(spark, sf_dir, "conversations"))


ORACLE = """
with numbered as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos
  from (select distinct conv_id, turn, role, text from conversations)),
turns as (select conv_id, pos, role, text, list({'r': role, 't': text}) over (partition by conv_id order by pos rows between unbounded preceding and current row) as so_far,
  count(*) over (partition by conv_id) as n from numbered),
inner_prefix as (select distinct so_far from turns where pos < n),
whole as (select so_far, min(conv_id) as conv_id, count(*) as n_copies from turns where pos = n group by so_far),
kept as (select * from whole where so_far not in (select so_far from inner_prefix))
select k.conv_id, count(*) as n_turns, any_value(n_copies) as n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by pos) as rendered
from kept k join turns t on k.conv_id is not distinct from t.conv_id group by k.conv_id
"""
