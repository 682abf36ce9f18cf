"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.scratch import shuffle_partitions, stored

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", instruction: str = "system") -> DataFrame:
    """Every dialogue once per participant: that speaker as assistant, all others as named users.

    One row per (conversation, perspective, turn): conv_id, perspective, turn, position (from 0), role, name,
    segment (the rendered text), seg_start and seg_end (offsets in code points in the whole rendered dialogue), mask_start and
    mask_end (the part on which an assistant's loss counts: its text and end mark; equal offsets elsewhere).
    The segments of one perspective in order of position, put together, are its rendered dialogue.

    Speakers equal to ``instruction`` are no participants: they render as system in every perspective. A null
    speaker is named "unknown", a null text is empty, rows without a conversation id are dropped. Rows of one turn come in order of
    speaker and text, equal rows all stay. Marks inside a text are broken up (a space after "<"), so a text
    can't end its own segment. A conversation without participants has no rows, an empty table gives an empty one. Columns
    other than the four aren't read, so their names may clash with any here.

    The turns are dealt to shuffle partitions by ranges of (conversation, turn, speaker, text). Positions and offsets are
    running sums within a partition's part of a conversation and then over the parts' totals, so a conversation of any
    length is spread and never sorted in one task, also where all its turns have one number or none.
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.where("conv is not null").withColumn("text", F.replace("text", F.lit("<|"), F.lit("< |")))
    t = t.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("times")).withColumn("system", F.col("speaker") == instruction)
    # stored, so that the parts stay the same for all that is derived from them
    t = stored(t.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv", "turn", "speaker", "text").withColumn("block", F.spark_partition_id()), "turns")
    people = t.where("not system").select("conv", F.col("speaker").alias("perspective")).distinct()
    rows = t.join(people, "conv").withColumn("me", F.col("speaker") == F.col("perspective"))
    role = F.when(F.col("me"), "assistant").when(F.col("system"), "system").otherwise("user")
    name = F.when(~F.col("me") & ~F.col("system"), F.col("speaker"))
    head = F.concat(F.lit(BEGIN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    rows = rows.withColumns({"role": role, "name": name, "head": F.length(head).cast("long"), "segment": F.concat(head, "text", F.lit(END + "\n"))})
    rows = rows.withColumn("len", F.length("segment").cast("long")).withColumn("room", F.col("len") * F.col("times"))
    own = Window.partitionBy("conv", "perspective", "block")
    so_far = own.orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"p0": F.coalesce(F.sum("times").over(so_far), F.lit(0)), "o0": F.coalesce(F.sum("room").over(so_far), F.lit(0))})
    blocks = rows.groupBy("conv", "perspective", "block").agg(F.sum("times").alias("n"), F.sum("room").alias("chars"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "perspective", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("p1"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("o1"))
    rows = rows.join(blocks, ["conv", "perspective", "block"])
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    start = F.col("o1") + F.col("o0") + F.col("i") * F.col("len")
    end = start + F.col("len")
    mask_start = F.when(F.col("me"), start + F.col("head")).otherwise(start)
    mask_end = F.when(F.col("me"), end - 1).otherwise(start)
    return rows.select(F.col("conv").alias(conv), "perspective", F.col("turn").alias(turn), (F.col("p1") + F.col("p0") + F.col("i")).alias("position"), "role", "name", "segment", start.alias("seg_start"), end.alias("seg_end"), mask_start.alias("mask_start"), mask_end.alias("mask_end"))
