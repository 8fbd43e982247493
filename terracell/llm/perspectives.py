"""Dialogues seen by each of their speakers in turn (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranged


def escaped(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, system: str = "system", part_turns: int = 256) -> DataFrame:
    """Render every conversation once per speaker, with that speaker as assistant and the others as named users.

    turns: conv_id, turn, role, text. Turns are ordered by turn (nulls last), then role and text. Each becomes
    `<|start|>assistant`, `<|start|>user NAME` or `<|start|>system`, a line break, the text, `<|end|>` and a line break. The
    masks are the character spans of the assistant's texts with their end marker, which is what a model learns to say.

    A conversation of more than part_turns turns comes in several parts, each rendered and masked on its own, so no row, task
    or group grows with a conversation: turns are numbered through range partitions and counts per partition, and
    speakers meet turns part by part.

    Returns conv_id, speaker, part int (0, 1, ...), n_turns long, text, masks array<struct<start:long,end:long>>.

    Null text is empty; `<|` in a text or name becomes `< |`. A turn without a role is said by `unknown`, who has no
    perspective of their own; `system` turns are instructions, not a speaker's. A conversation without a speaker gives no row. Turns
    without conv_id form one conversation. Repeated turns are all rendered. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = turns.select("conv_id", F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = ranged(rows.withColumn("no_turn", F.col("turn").isNull()), "conv_id", "no_turn", "turn", "role", "text")
    inside = Window.partitionBy("part", "conv_id").orderBy("no_turn", "turn", "role", "text")
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("part").alias("p"), F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("p", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"))
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1).join(
        counts, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))
    )
    numbered = numbered.withColumn("at", F.col("turns_before") + F.col("at"))
    numbered = numbered.select("conv_id", "role", "text", "at", F.expr(f"cast(at div {part_turns} as int)").alias("piece"))

    speakers = rows.filter(F.col("role") != system).select(F.col("conv_id").alias("s"), F.col("role").alias("speaker")).distinct()
    pieces = numbered.select(F.col("conv_id").alias("c"), F.col("piece").alias("k")).distinct()
    views = pieces.join(speakers, F.col("c").eqNullSafe(F.col("s"))).select("c", "k", "speaker")
    said = numbered.join(views, (F.col("piece") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c")))

    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    name = F.translate(escaped(F.coalesce("role", F.lit("unknown"))), "\n", " ")
    who = F.when(own, "assistant").when(F.col("role") == system, "system").otherwise(F.concat(F.lit("user "), name))
    segments = said.select(
        "conv_id",
        "speaker",
        F.col("piece").alias("part"),
        "at",
        own.alias("own"),
        F.concat(F.lit("<|start|>"), who, F.lit("\n")).alias("head"),
        F.concat(escaped(F.col("text")), F.lit("<|end|>")).alias("body"),
    )
    by_part = Window.partitionBy("conv_id", "speaker", "part").orderBy("at")
    length = F.char_length("head") + F.char_length("body") + 1
    segments = segments.withColumn("end", F.sum(length).over(by_part) - 1)
    mask = F.struct((F.col("end") - F.char_length("body")).alias("start"), F.col("end").alias("end"))
    turn = F.struct("at", F.concat("head", "body", F.lit("\n")).alias("text"), F.when(F.col("own"), mask).alias("mask"))
    grouped = segments.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("masks"),
    )
