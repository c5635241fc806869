"""Content keys: what makes two messages or two attachments the same.

A message is its sender and the fingerprint of its body; recipient, subject and time don't count. An attachment is its
name. A key travels as the 32 bytes of its SHA-256 (`key`), so joins and shuffles carry no bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X


def key_of(kind: Column, sender: Column, value: Column) -> Column:
    """Lengths in front keep the parts apart."""
    return F.unhex(F.sha2(F.concat_ws(":", kind, F.length(sender).cast("string"), sender, value), 256))


def message_key(sender: Column, body: Column) -> Column:
    return key_of(F.lit("msg"), X.normal_sender(sender), X.fingerprint(body))


def attachment_key(name: Column) -> Column:
    return key_of(F.lit("att"), F.lit(""), F.lower(X.strip(X.text(name))))


def key_id(key: Column) -> Column:
    """A short name of a key for links between views: 16 hexadecimal digits."""
    return F.lower(F.hex(F.substring(key, 1, 8)))


def with_keys(messages: DataFrame) -> DataFrame:
    """messages plus `key`, the message's content key."""
    return messages.withColumn("key", message_key(F.col("sender"), F.col("body")))


def file_keys(messages: DataFrame, file_col: str = "file_id") -> DataFrame:
    """file_id, key: each file's distinct content keys, of messages and of attachments."""
    kinds = [message_key(F.col("sender"), F.col("body"))]
    names = F.col("attachments") if "attachments" in messages.columns else F.array().cast("array<string>")
    both = F.concat(F.array(*kinds), F.transform(F.coalesce(names, F.array().cast("array<string>")), attachment_key))
    return messages.select(F.col(file_col).alias("file_id"), F.explode(both).alias("key")).distinct()


def files_of(messages: DataFrame) -> DataFrame:
    """file_id, name of the files that have messages; add message-less files yourself."""
    return messages.groupBy("file_id").agg(F.min("name").alias("name"))
