"""Operator 7, chat formatting with multi-party perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which this speaker's turns are the
assistant's and all others' are turns of named users; turns of roles in `setting` (system prompts) stay what they are in
every rendering and get none of their own. The result is a row for each turn and perspective with the segment's text,
its place in the rendering, and the part to train on, so no task holds a conversation. `assembled` joins a
rendering's segments for those who want one string.

Turns are in order of turn, speaker, text; places are prefix sums in two steps, first over blocks of turns and then
within a block, so that a conversation of any length spreads over tasks.

Cases: a "<|" in a text or name is written "< |", and a "|>" or line feed in a name "| >" or a blank, so that only the
operator makes marks; turns that share a number, null ones too, are placed in one task; a null text is empty; a null speaker is "unknown"; a null turn comes first; repeated rows are turns of their own;
a conversation of setting turns alone has no rendering; a null conv_id is one conversation; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import col

SETTING = ("system",)
#: Turns in a block of the prefix sums.
BLOCK = 1000


def rotate(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", setting: tuple[str, ...] = SETTING, block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, segment, start, end, train_start, train_end), places in characters."""
    said = turns.select(col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), F.coalesce(col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    is_setting = F.col("speaker").isin(*setting) if setting else F.lit(False)
    parts = said.filter(~is_setting).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    # Marks that a text or a name holds are broken up, so that neither forges a turn.
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.replace(plain("speaker"), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" "))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(is_setting, name).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit("<|"), role, F.when(~is_setting & ~own, F.concat(F.lit(" name="), name)).otherwise(""), F.lit("|>\n"))
    cut = seen.select("*", role.alias("role"), F.char_length(head).alias("n_head"), F.concat(head, plain("text"), F.lit("<|end|>\n")).alias("segment"))
    cut = cut.withColumn("n", F.char_length("segment").cast("long")).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))

    rendering = ["conv_id", "perspective"]
    blocks = cut.groupBy(*rendering, "block").agg(F.sum("n").alias("n_block"))
    before = F.sum("n_block").over(Window.partitionBy(*rendering).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = cut.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("block") == F.col("_b")))
    within = F.sum("n").over(Window.partitionBy(*rendering, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("before") + F.col("within")
    trained = F.col("role") == "assistant"
    return placed.withColumn("within", within).select(
        *rendering, "turn", "speaker", "role", "segment",
        (end - F.col("n")).alias("start"), end.alias("end"),
        F.when(trained, end - F.col("n") + F.col("n_head")).alias("train_start"),
        F.when(trained, end - 1).alias("train_end"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendering, train): one string for each rendering and its ranges to train on."""
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "segment", "train_start", "train_end")))
    whole = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    train = F.transform(F.filter("parts", lambda p: p["train_start"].isNotNull()), lambda p: F.struct(p["train_start"].alias("start"), p["train_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendering"), train.alias("train"))


def op7_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
j AS (SELECT s.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || replace(replace(replace(speaker, '<|', '< |'), '|>', '| >'), chr(10), ' ') ELSE '' END || '|>' || chr(10) AS head FROM j),
g AS (SELECT *, head || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS segment FROM h),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM g)
SELECT conv_id, perspective, turn, speaker, as_role AS role, segment, stop - length(segment) AS start, stop AS "end",
       CASE WHEN as_role = 'assistant' THEN stop - length(segment) + length(head) END AS train_start, CASE WHEN as_role = 'assistant' THEN stop - 1 END AS train_end
FROM e
"""
