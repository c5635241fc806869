"""Exports that arrive over time: a file stream whose micro-batches are upserted into a store, and one whose state is the
earliest occurrence of every message.

Order and lateness need no watermark: a message's row is an aggregate over all its occurrences, whenever they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions import text as X
from strandline.operators.keys import message_key
from strandline.operators.ranking import ranked
from strandline.operators.store import Store
from strandline.schema import MESSAGE_FIELDS
from strandline.scratch import passing, table
from strandline.sources.files import decoded, name_of, parse_files
from strandline.sources.text_exports import parse_exports

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_exports(spark: SparkSession, directory: str, store_path: str, checkpoint: str, pattern: str = "*.{txt,eml,mbox}", stamp: str = "", files_per_batch: int = 10_000) -> StreamingQuery:
    """Start a query that takes new files of a directory into a store. A batch that is replayed after a failure counts once."""
    store = Store(spark, store_path)
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(directory)

    def take(batch: DataFrame, number: int) -> None:
        with passing():
            content = table(batch.select("path", name_of(F.col("path")).alias("name"), "content"), "arrived")
            ids = ranked(content.select("path", "name"), ["path"]).select("path", "name", (F.col("ordinal") - 1).alias("file_id"))
            messages = table(parse_files(content.drop("name").join(ids, "path")), "messages")
            store.add(messages, ids.select("file_id", "path", "name"), stamp or f"batch-{number}", str(number))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_messages(spark: SparkSession, directory: str) -> DataFrame:
    """Messages of text exports as a stream: parsing has no state, so the batch operators run as they are."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.txt").load(directory)
    return parse_exports(files.select(F.xxhash64("path").alias("file_id"), name_of(F.col("path")).alias("name"), decoded(F.col("content")).alias("text")))


#: What the state holds of a message: the fields of its earliest occurrence and the path of that one's file.
KEPT = ["path", *[c for c in MESSAGE_FIELDS if c not in ("file_id", "name")]]


def stream_unique(spark: SparkSession, directory: str, out: str, checkpoint: str, pattern: str = "*.txt", files_per_batch: int = 10_000) -> StreamingQuery:
    """Start a query that keeps the earliest occurrence of every message of text exports, in whatever order files arrive.

    The state has one row for each content key: arg-min by time, path and place, the first place, and a count, all of them
    partial aggregates. A micro-batch writes the rows that it changed into a folder of its number, so a batch that is
    replayed writes the same again. unique_so_far() reads them.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(directory)
    rows = parse_exports(files.select(F.xxhash64("path").alias("file_id"), F.col("path").alias("name"), decoded(F.col("content")).alias("text")))
    rows = rows.withColumnRenamed("name", "path").withColumn("key", message_key(F.col("sender"), F.col("body"))).withColumn("ts", X.sent_at(F.col("timestamp")))
    earliest = F.min_by(F.struct(*KEPT, "ts"), F.struct("ts", "path", "msg_idx"))
    best = rows.groupBy("key").agg(earliest.alias("row"), F.min(F.struct("path", "msg_idx")).alias("first_seen"), F.count(F.lit(1)).alias("occurrences"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return best.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_so_far(spark: SparkSession, out: str) -> DataFrame:
    """key, path and fields of each message's earliest occurrence, ts, first_seen (path, msg_idx), occurrences: each key as its latest batch left it."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("key").agg(F.max_by(F.struct("row", "first_seen", "occurrences"), "batch").alias("x"))
    return last.select("key", "x.row.*", "x.first_seen", "x.occurrences")
