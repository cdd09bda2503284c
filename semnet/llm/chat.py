"""Chat formatting after cumulative-snapshot collapse.

Loggers write a conversation again with each turn, so many logged
conversations are prefixes of longer ones.  Every turn is hashed together with
its position; the running sum of these hashes identifies a prefix.  A
conversation whose whole hash is a proper prefix of another one is dropped by
an anti-join; of equal conversations the least id stays.  What remains is
rendered in blocks of turns, so no group is unbounded.

Numbering and prefixes work on keys and hashes alone; the texts of the
conversations that stay are read once more to be rendered.  Turns are dealt by
the turn number and, where very many rows of a conversation fall into one range
of numbers, by turn and a prefix of their digest, so neither a very long
conversation nor very many rows of one turn, or of no id, are sorted in one task.

Defined results: turns are ordered by turn (nulls first), then by the MD5 of
the role's length, a colon, role and text; repeated rows of a turn are one row; a null role or text counts
as empty and renders so; a null id is a conversation of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import MOST_ROWS, Scratch

#: Turns of one rendered row, and of one range of turn numbers.
BLOCK = 256
#: A range with more rows than this is dealt on by turn and digest.
HEAVY = 4096
BEGIN, END = "<|im_start|>", "<|im_end|>"
CELL = ["conv", "range", "at", "sub"]


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; ``right`` is broadcast if it is a kept table of few rows."""
    rows = getattr(right, "n_rows", MOST_ROWS + 1)
    right = right.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(F.broadcast(right) if rows <= MOST_ROWS else right, same, how).drop(*(f"_r_{c}" for c in on))


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct turns (conv, turn, digest) with their cell, ``pos``, their position in the conversation, and ``total``, its turns.

    Positions are ranks inside cells plus the sizes of the cells before.
    """
    rows = turns.select("conv", "turn", "digest").distinct().withColumn("range", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    rows = scratch.keep(rows)
    heavy = scratch.keep(rows.groupBy("conv", "range").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY))
    if heavy.n_rows:
        chars = F.least(F.lit(32), F.ceil(F.log(16.0, F.col("n") / BLOCK))).cast("int")
        heavy_ = heavy.select("conv", "range", chars.alias("chars"))
        heavy_.n_rows = heavy.n_rows
        rows = _same(rows, heavy_, ["conv", "range"], "left")
        rows = rows.withColumn("at", F.when(F.col("chars").isNotNull(), F.col("turn"))).withColumn("sub", F.coalesce(F.col("digest").substr(F.lit(1), F.col("chars")), F.lit(""))).drop("chars")
    else:
        rows = rows.withColumn("at", F.lit(None).cast("long")).withColumn("sub", F.lit(""))
    whole, order = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("range", F.col("at").asc_nulls_first(), "sub")
    cells = rows.groupBy(*CELL).agg(F.count("*").alias("n"))
    cells = cells.select(*CELL, (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.col("turn").asc_nulls_first(), "digest"))
    out = _same(rows.withColumn("rank", rank), cells, CELL)
    return scratch.keep(out.select(*CELL, "turn", "digest", (F.col("before") + F.col("rank")).alias("pos"), "total"))


def maximal(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, digest, pos, n_turns, copies): the numbered turns of the conversations that no other one continues, the least id of equal ones."""
    rows = _numbered(turns, scratch)
    h = rows.select(*CELL, "pos", "total", *(F.xxhash64(F.lit(k), F.col("pos"), F.col("digest")).alias(f"h{k}") for k in (1, 2)))
    # running hashes inside a cell, and those of the cells before
    part = h.groupBy(*CELL).agg(*(F.bit_xor(f"h{k}").alias(f"t{k}") for k in (1, 2)))
    back = Window.partitionBy("conv").orderBy("range", F.col("at").asc_nulls_first(), "sub").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*CELL, *(F.coalesce(F.bit_xor(f"t{k}").over(back), F.lit(0).cast("long")).alias(f"b{k}") for k in (1, 2)))
    inside = Window.partitionBy(*CELL).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = h.select(*CELL, "pos", "total", *(F.bit_xor(f"h{k}").over(inside).alias(f"r{k}") for k in (1, 2)))
    prefix = _same(run, part, CELL).select("conv", F.col("pos").alias("k"), "total", *(F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"s{k}") for k in (1, 2)))
    prefix = scratch.keep(prefix)
    classes = prefix.where("k = total").groupBy("k", "s1", "s2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    proper = prefix.where("k < total").select("k", "s1", "s2").distinct()
    kept = scratch.keep(classes.join(proper, ["k", "s1", "s2"], "left_anti").select("conv", F.col("k").alias("n_turns"), "copies"))
    return scratch.keep(_same(rows.select("conv", "turn", "digest", "pos"), kept, ["conv"]))


def render(turns: DataFrame) -> DataFrame:
    """(conv, block, n_turns, copies, rendered): chat markup of blocks of turns."""
    line = F.concat(F.lit(BEGIN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    rows = turns.select("conv", "n_turns", "copies", F.floor((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), "pos", line.alias("line"))
    # at most BLOCK turns in a group
    parts = F.sort_array(F.collect_set(F.struct("pos", "line")))
    out = rows.groupBy("conv", "block").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), parts.alias("p"))
    return out.select("conv", "block", "n_turns", "copies", F.array_join(F.transform("p", lambda x: x["line"]), "").alias("rendered"))


def chat_format(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    scratch = Scratch(conversations.sparkSession, "chat")
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("digest"), who.alias("role"), said.alias("text"),
    )
    kept = maximal(turns, scratch)
    # the texts join by turn, not by conversation; a repeated turn adds the same line again
    return render(_same(turns, kept, ["conv", "turn", "digest"])).withColumnRenamed("conv", conv)
