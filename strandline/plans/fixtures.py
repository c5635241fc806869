"""Relations that the catalogue's queries start from: exports of conversations, timeline events of the events table.

A conversation becomes overlapping exports, as mail clients leave them: all of it, its first turns, a middle part, the
opening alone, all but the last turn under shifted times. Each has its DuckDB twin as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (suffix, condition on turn and last turn, hours that its times are shifted by).
ROLES = [("full", "true", 0), ("early", "turn < 2", 0), ("mid", "turn between 1 and 2", 0), ("open", "turn = 0", 0), ("tzdup", "turn < last", 8)]
FORKS = [("brancha", "turn in (0, 1, 2)", 0), ("branchb", "turn in (0, 1, 3)", 0), ("branchc", "turn in (0, 1, 4)", 0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exports(spark: SparkSession, sf_dir: str, roles: list = ROLES, least_turns: int = 1) -> DataFrame:
    """Messages (schema.MESSAGE and conv_id, turn) of each conversation's exports."""
    turns = read(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).where(F.col("last") + 1 >= least_turns)
    rows = turns.join(last, "conv_id")
    role = F.explode(F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(h).alias("h"))) for k, (s, c, h) in enumerate(roles)]), lambda x: x.isNotNull()))
    rows = rows.select("*", role.alias("x"))
    minutes = F.col("conv_id") * 60 + F.col("turn") * 7 + F.col("x.h") * 60
    stamp = F.date_format(F.timestamp_seconds(F.lit(1735689600) + minutes * 60), "yyyy-MM-dd HH:mm")
    name = F.format_string("conv_%06d_%s.txt", "conv_id", "x.s")
    none = F.array().cast("array<string>")
    return rows.select(
        (F.col("conv_id") * 16 + F.col("x.k")).alias("file_id"), name.alias("name"), F.col("turn").cast("int").alias("msg_idx"), F.col("role").alias("sender"), stamp.alias("timestamp"), F.lit("").alias("recipient"),
        F.concat(F.when(F.col("turn") > 0, F.lit("RE: ")).otherwise(F.lit("")), F.lit("Topic "), F.col("conv_id") % 40).alias("subject"), none.alias("attachments"), F.col("text").alias("body"),
        F.format_string("<%d-%d@x>", "conv_id", "turn").alias("message_id"), F.when(F.col("turn") > 0, F.format_string("<%d-%d@x>", F.col("conv_id"), F.col("turn") - 1)).otherwise(F.lit("")).alias("in_reply_to"), none.alias("references"), "conv_id", "turn",
    )


def files_of(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file_id").agg(F.min("name").alias("name"))


def exports_sql(roles: list = ROLES, least_turns: int = 1) -> str:
    parts = " UNION ALL ".join(f"SELECT *, {k} AS k, '{s}' AS s, {h} AS h FROM turns WHERE {c}" for k, (s, c, h) in enumerate(roles))
    return f"""
turns AS (SELECT * FROM conversations JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id HAVING max(turn) + 1 >= {least_turns}) USING (conv_id)),
exports AS (
  SELECT conv_id * 16 + k AS file_id, printf('conv_%06d_%s.txt', conv_id, s) AS name, turn, role AS sender, conv_id, text AS body,
         strftime(TIMESTAMP '2025-01-01' + to_minutes(CAST(conv_id * 60 + turn * 7 + h * 60 AS BIGINT)), '%Y-%m-%d %H:%M') AS ts,
         CASE WHEN turn > 0 THEN 'RE: ' ELSE '' END || 'Topic ' || (conv_id % 40) AS subject,
         role || chr(1) || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k
  FROM ({parts}))"""


PAIRS_SQL = """
keys AS (SELECT DISTINCT name, k FROM exports),
sizes AS (SELECT name, count(*) AS n FROM keys GROUP BY name),
shared AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM keys a JOIN keys b ON a.k = b.k AND a.name <> b.name GROUP BY ALL),
pairs AS (
  SELECT a, b FROM shared JOIN sizes x ON x.name = a JOIN sizes y ON y.name = b
  WHERE c = x.n AND (x.n < y.n OR (x.n = y.n AND b < a))),
states AS (SELECT name, n AS n_keys, name IN (SELECT a FROM pairs) AS redundant FROM sizes)"""


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the events table: a tab for each month, a category for each type, a group for each ten users."""
    e = read(spark, sf_dir, "events")
    importance = F.pmod(F.floor(F.col("value")), F.lit(4)).cast("int")
    return e.select(
        F.date_format("ts", "yyyy-MM").alias("tab"), F.col("event_id").alias("pos"), F.concat(F.lit("g"), F.col("user_id") % 10).alias("group_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat("event_type", F.lit(" "), "event_id").alias("title"),
        F.col("event_type").alias("category"), F.col("event_type").alias("category_label"), F.coalesce(importance, F.lit(0)).alias("importance"), F.when(F.col("user_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("phase "), F.col("user_id") % 4)).alias("phase"),
    )


EVENTS_SQL = """
tl AS (
  SELECT strftime(ts, '%Y-%m') AS tab, event_id AS pos, 'g' || (user_id % 10) AS group_id, strftime(ts, '%Y-%m-%d') AS date, event_type || ' ' || event_id AS title, event_type AS category,
         coalesce(CAST(((floor(value) % 4) + 4) % 4 AS INTEGER), 0) AS importance, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'phase ' || (user_id % 4) END AS phase
  FROM events)"""
