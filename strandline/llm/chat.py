"""Chat formatting for dialogues of several parties: one rendering per participant, in DataFrame operations.

In a participant's perspective that participant's turns are the assistant's, all others' are a named user's. A
rendered turn is header + text + end; concatenated by seq, the turns of one perspective are the rendered dialogue.
The loss mask is a span: an assistant turn's text and end mark count, everything else doesn't. start and end place a
turn in its rendered dialogue (in characters), mask_start and mask_end the part that counts. What reads like a marker
in a name or a text is broken up, so no turn can pass for another speaker's.

One row is one turn of one perspective, so a dialogue of any length is never gathered in one place. Running positions
are sums inside blocks of turns plus sums of blocks. Equal rows are one row with a count until the end. Turns without a
number are a block of their own, before all others. Blocks with very many rows (turns without a number, or one number for
all) are cut into ranges of turn, name and text that Spark makes equally large, so a hot conversation is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.scratch import table

#: Roles that give context and are no party of the talk: named users in every perspective.
CONTEXT_ROLES = ("system",)
NO_NAME = "unnamed"
HEADER = "<|im_start|>{role}{name}\n"
END = "<|im_end|>\n"
#: Turn numbers of one block; a conversation's blocks are ranked and summed in parallel.
BLOCK = 64
#: Rows of a block beyond which it is cut into ranges, and copies of a turn that are written out together.
LARGE_BLOCK, COPIES = 100_000, 4096


def _header(is_own: Column, role: Column) -> Column:
    user = F.concat(F.lit(HEADER.split("{role}")[0] + "user name="), role, F.lit("\n"))
    return F.when(is_own, F.lit(HEADER.format(role="assistant", name=""))).otherwise(user)


def plain(c: Column) -> Column:
    """Text in which no marker can stand: a space parts the beginning of what could be one."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(conversations: DataFrame, context_roles: tuple[str, ...] = CONTEXT_ROLES, block: int = BLOCK, large: int = LARGE_BLOCK) -> DataFrame:
    """conv_id, perspective, seq, turn, chat_role, name, rendered, mask, start, end, mask_start, mask_end.

    Participants are the distinct roles of a conversation but the context roles; where only context roles speak, they
    are the participants, so no conversation is lost. Order: turn (null first), then role, then text; equal rows are
    turns of their own. Line ends in a role are spaces; "<|" in a role or text becomes "< |". Null or empty role:
    "unnamed". Null text: an empty turn. Null conv_id: one conversation of its own. Empty table: no rows. Other columns
    are not read.
    """
    c = conversations
    name = F.trim(F.regexp_replace(plain(c["role"].cast("string")), "[\r\n]+", " "))
    turns = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_NAME)).alias("role"), plain(F.coalesce(c["text"].cast("string"), F.lit(""))).alias("text"),
    )
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / block))
    # Once written, the sums, the ranks and the result read the same rows.
    turns = table(turns, "turns")
    crowded = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select(F.col("conv_id").alias("h_conv_id"), F.col("block").alias("h_block"))
    if crowded.limit(1).count():
        crowded = table(crowded, "crowded-blocks")
        hot = turns["conv_id"].eqNullSafe(crowded["h_conv_id"]) & turns["block"].eqNullSafe(crowded["h_block"])
        # Equal rows are one, so any range can be cut in two. Written: a row's range stays what it is.
        ranges = turns.join(crowded, hot, "left_semi").repartitionByRange("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
        turns = turns.join(crowded, hot, "left_anti").withColumn("part", F.lit(0)).unionByName(table(ranges, "ranges"))
        turns = turns.withColumn("block", F.struct("block", "part")).drop("part")

    speakers = turns.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")).withColumn("context", F.col("role").isin(*context_roles) if context_roles else F.lit(False))
    talk = speakers.groupBy("conv_id").agg(F.min("context").alias("only_context"), F.collect_set(F.when(~F.col("context"), F.col("role"))).alias("parties"), F.collect_set("role").alias("all"))
    talk = talk.select("conv_id", F.explode(F.when(F.col("only_context"), F.col("all")).otherwise(F.col("parties"))).alias("perspective"))
    # A perspective needs the name alone, so what is joined is small; a hot conversation's turns are split by the skew join.
    rows = turns.join(talk, turns["conv_id"].eqNullSafe(talk["conv_id"])).drop(talk["conv_id"])
    own = F.col("role") == F.col("perspective")
    rows = rows.withColumn("own", own).withColumn("header", _header(own, F.col("role")))
    rows = rows.withColumn("size", (F.length("header") + F.length("text") + len(END)).cast("long"))

    place = ["conv_id", "perspective"]
    sums = rows.groupBy(*place, "block").agg(F.sum(F.col("size") * F.col("times")).alias("chars"), F.sum("times").alias("n"))
    before = Window.partitionBy(*place).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"b_{k}") for k in (*place, "block")], F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    order = Window.partitionBy(*place, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.coalesce(F.sum("times").over(order), F.lit(0))).withColumn("upto", F.coalesce(F.sum(F.col("size") * F.col("times")).over(order), F.lit(0)))
    rows = rows.join(sums, rows["conv_id"].eqNullSafe(sums["b_conv_id"]) & (rows["perspective"] == sums["b_perspective"]) & rows["block"].eqNullSafe(sums["b_block"]))
    # Copies come in parts, so no list is longer than a part or the number of parts.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))))
    rows = rows.withColumn("time", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("times"), (F.col("part") + 1) * COPIES) - 1)))
    start = F.col("chars_before") + F.col("upto") + F.col("time") * F.col("size")
    end = start + F.col("size")
    return rows.select(
        "conv_id", "perspective", (F.col("n_before") + F.col("nth") + F.col("time")).alias("seq"), "turn", F.when(F.col("own"), F.lit("assistant")).otherwise(F.lit("user")).alias("chat_role"), F.col("role").alias("name"),
        F.concat("header", "text", F.lit(END)).alias("rendered"), F.col("own").cast("int").alias("mask"), start.alias("start"), end.alias("end"),
        F.when(F.col("own"), start + F.length("header")).alias("mask_start"), F.when(F.col("own"), end).alias("mask_end"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(replace(role, '<|', '< |'), '[\r\n]+', ' ', 'g')), ''), 'unnamed') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role FROM turns),
only_context AS (SELECT conv_id, bool_and(role = 'system') AS only_context FROM speakers GROUP BY conv_id),
parties AS (
  SELECT s.conv_id, s.role AS perspective FROM speakers s JOIN only_context o ON s.conv_id IS NOT DISTINCT FROM o.conv_id
  WHERE o.only_context OR s.role <> 'system'),
seen AS (
  SELECT t.*, p.perspective, t.role = p.perspective AS own,
         CASE WHEN t.role = p.perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || t.role || chr(10) END AS header
  FROM turns t JOIN parties p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, CAST(length(header) + length(text) + 11 AS BIGINT) AS size FROM seen),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, seq, turn, CASE WHEN own THEN 'assistant' ELSE 'user' END AS chat_role, role AS name,
       header || text || '<|im_end|>' || chr(10) AS rendered, CAST(own AS INTEGER) AS mask, e - size AS start, e AS "end",
       CASE WHEN own THEN e - size + length(header) END AS mask_start, CASE WHEN own THEN e END AS mask_end
FROM placed
"""
