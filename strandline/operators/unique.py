"""Unique messages: of all occurrences of a content key the earliest, ties by file order and place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators.keys import message_key


def unique_messages(messages: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row for each content key (and value of `within`): the earliest occurrence, plus key, ts, first_seen.

    first_seen is the place of the key's first occurrence in file order; rows of one time are ordered by it. An arg-min
    by partial aggregates: a message that is in a third of all files meets as one row for each task.
    """
    rows = messages.withColumn("key", message_key(F.col("sender"), F.col("body"))).withColumn("ts", X.sent_at(F.col("timestamp")))
    place = F.struct("file_id", "msg_idx")
    best = rows.groupBy(*within, "key").agg(F.min_by(F.struct(*messages.columns, "ts"), F.struct("ts", "file_id", "msg_idx")).alias("row"), F.min(place).alias("first_seen"), F.count(F.lit(1)).alias("occurrences"))
    return best.select("key", "row.*", "first_seen", "occurrences")  # row has the columns of `within` too


def duplicate_counts(messages: DataFrame) -> DataFrame:
    """One row: total, unique_messages, duplicates."""
    rows = messages.select(message_key(F.col("sender"), F.col("body")).alias("key"))
    by_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_messages")).withColumn("duplicates", F.col("total") - F.col("unique_messages"))


def folder_counts(messages: DataFrame, folder_col: str = "folder") -> DataFrame:
    """folder, total, unique_messages: duplicates count inside a folder only."""
    rows = messages.select(F.col(folder_col).alias("folder"), message_key(F.col("sender"), F.col("body")).alias("key"))
    return rows.groupBy("folder", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("folder").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_messages"))


def file_summary(messages: DataFrame) -> DataFrame:
    """file_id, name, n_messages, attachments (distinct names in order)."""
    named = messages.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n_messages"), F.flatten(F.collect_set("attachments")).alias("all"))
    return named.select("file_id", "name", "n_messages", F.array_sort(F.array_distinct(F.filter("all", lambda x: x != ""))).alias("attachments"))
