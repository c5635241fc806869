"""The accumulating store: what every batch brought, kept apart and merged by aggregates when it is read.

A message's row is the earliest of its occurrences ever taken in, except message_id (the first that wasn't empty) and
first_seen (the first stamp). All of these are aggregates that can be taken of parts, so adding a batch writes the batch's
own rows and no others. A file's latest batch tells which messages it holds.

Parts are levels of a merge tree: a batch is a part of level 0, and when a level has COMPACT parts they become one of the
next level, so a row is rewritten as often as the store has levels. A part's files are sorted by key or path and carry
Bloom filters of it. A small batch looks its keys and paths up by pushed-down equalities, so of the stored parts only the
pages that may hold one are read, and only their keys; a large batch is joined. How many files and messages there are is
counted as they come, in the manifest.

Order is a struct of batch, file and place in the file, so nothing overlaps however large a mailbox is.
"""

from __future__ import annotations

import json
import operator
import os
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators.contain import covered
from strandline.operators.keys import attachment_key, message_key
from strandline.operators.ranking import ranked
from strandline.scratch import passing, table

SEQ = "struct<batch:long,file:long,idx:int>"
FILES = "file_id long, path string, name string, ingested_at string, batch long"
MESSAGES = (
    "key binary, sender string, timestamp string, recipient string, subject string, body string, attachments array<string>, in_reply_to string, references array<string>, "
    f"ts timestamp_ntz, best_seq {SEQ}, message_id string, id_seq {SEQ}, first_seen string, seen_seq {SEQ}, occurrences long"
)
FILE_MESSAGES = "file_id long, key binary, batch long"
FILE_ATTACHMENTS = "file_id long, name string, batch long"
SCHEMAS = {"files": FILES, "messages": MESSAGES, "file_messages": FILE_MESSAGES, "file_attachments": FILE_ATTACHMENTS}
_BODY = ("sender", "timestamp", "recipient", "subject", "body", "attachments", "in_reply_to", "references")
#: Parts of a level that are kept apart before they are merged into one of the next level.
COMPACT = 8
#: Values that are looked up by equalities, which Parquet's statistics and Bloom filters answer; more are joined.
LOOKUP = 512
#: What the files of a part's tables are sorted by; lookups go by it.
SORTED = {"files": "path", "messages": "key", "file_messages": "file_id", "file_attachments": "file_id"}
#: Seconds for which parts stay that a merge has replaced, for readers of an older manifest.
RETAIN = 7 * 24 * 3600


@dataclass
class Tables:
    files: DataFrame
    messages: DataFrame
    file_messages: DataFrame
    file_attachments: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Tables:
        return cls(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})

    def each(self, f) -> Tables:
        return Tables(**{k: f(k, getattr(self, k)) for k in SCHEMAS})


def merged_messages(rows: DataFrame) -> DataFrame:
    """One row for each key: rows may be single occurrences or merged before."""
    out = rows.groupBy("key").agg(
        F.min_by(F.struct(*_BODY, "ts", "best_seq"), F.struct("ts", "best_seq")).alias("row"), F.min_by(F.struct("message_id", "id_seq"), "id_seq").alias("mid"),
        F.min_by(F.struct("first_seen", "seen_seq"), "seen_seq").alias("seen"), F.sum("occurrences").alias("occurrences"),
    )
    out = out.select("key", "row.*", "mid.message_id", "mid.id_seq", "seen.*", "occurrences")
    return out.select("key", *_BODY, "ts", "best_seq", "message_id", "id_seq", "first_seen", "seen_seq", "occurrences")


def merge(parts: Tables) -> Tables:
    """The tables that several batches' parts make: each file as its latest batch has it."""
    files = parts.files.groupBy("file_id").agg(F.max_by(F.struct("path", "name", "ingested_at"), "batch").alias("f"), F.max("batch").alias("batch")).select("file_id", "f.*", "batch")
    latest = files.select("file_id", "batch")
    current = lambda t: t.join(latest, ["file_id", "batch"], "left_semi").select(*t.columns)
    return Tables(files, merged_messages(parts.messages), current(parts.file_messages), current(parts.file_attachments))


def batch_parts(known: DataFrame, top: int, batch: DataFrame, files: DataFrame, stamp: str, number: int) -> tuple[Tables, DataFrame]:
    """(what a batch adds, the batch's files with refreshed). batch: messages (schema.MESSAGE); files: file_id, path, name.

    known: path, file_id of stored files, of the batch's paths at least; top: the largest file_id that is stored, else -1.
    A path that is known keeps its id; its messages are those of this batch from now on.
    """
    # Repeated paths of a batch are one file.
    paths = files.groupBy("path").agg(F.min("file_id").alias("batch_id"), F.max("name").alias("name"))
    known = known.groupBy("path").agg(F.min("file_id").alias("old_id"))
    paths = paths.join(known, "path", "left")
    numbered = ranked(paths.where("old_id is null").select("batch_id"), ["batch_id"]).select("batch_id", (F.col("ordinal") + F.lit(top)).alias("new_id"))
    ids = paths.join(numbered, "batch_id", "left").select("batch_id", F.coalesce("old_id", "new_id").alias("file_id"), "path", "name", F.col("old_id").isNotNull().alias("refreshed"))
    ids = table(ids, "store-ids")
    every = files.select(F.col("file_id").alias("batch_id"), "path").join(ids.select("path", "file_id"), "path").select("batch_id", "file_id")
    rows = batch.withColumnRenamed("file_id", "batch_id").drop("name").join(every, "batch_id")
    rows = rows.withColumn("key", message_key(F.col("sender"), F.col("body"))).withColumn("ts", X.sent_at(F.col("timestamp")))
    n = F.lit(number).cast("long")
    seq = F.struct(n.alias("batch"), F.col("batch_id").cast("long").alias("file"), F.col("msg_idx").cast("int").alias("idx"))
    rows = table(rows.withColumn("seq", seq), "store-rows")
    given = F.nullif(X.text(F.col("message_id")), F.lit(""))
    new = rows.select("key", *_BODY, "ts", F.col("seq").alias("best_seq"), given.alias("message_id"), F.when(given.isNotNull(), F.col("seq")).alias("id_seq"), F.lit(stamp).alias("first_seen"), F.col("seq").alias("seen_seq"), F.lit(1).cast("long").alias("occurrences"))
    maps = rows.select("file_id", "key").distinct().withColumn("batch", n)
    names = rows.select("file_id", F.explode(F.coalesce("attachments", F.array().cast("array<string>"))).alias("name")).select("file_id", X.strip(X.text(F.col("name"))).alias("name")).where("name <> ''").distinct().withColumn("batch", n)
    taken = ids.select("file_id", "path", "name", F.lit(stamp).alias("ingested_at"), n.alias("batch"))
    return Tables(taken, merged_messages(new), maps, names), ids


def count_batch(known: DataFrame, added: Tables, ids: DataFrame) -> DataFrame:
    """One row: added and refreshed files, messages_added, messages_seen (occurrences that met a message that was stored,
    by an earlier batch or earlier in this one). known: key of stored messages, of the batch's at least."""
    new = added.messages.select("key", "occurrences").join(known.select("key").distinct().withColumn("old", F.lit(True)), "key", "left")
    told = new.agg(F.count_if(F.col("old").isNull()).alias("messages_added"), (F.coalesce(F.sum("occurrences"), F.lit(0)) - F.count_if(F.col("old").isNull())).alias("messages_seen"))
    files = ids.agg(F.count_if(~F.col("refreshed")).alias("added"), F.count_if("refreshed").alias("refreshed"))
    return files.crossJoin(told)  # one row each


def upsert(old: Tables, batch: DataFrame, files: DataFrame, stamp: str, number: int) -> tuple[Tables, DataFrame]:
    """The tables with a batch taken in, and its counters; for tables that aren't a Store's. number: the batch's, larger than those before."""
    top = old.files.agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0]
    added, ids = batch_parts(old.files.select("path", "file_id"), top, batch, files, stamp, number)
    both = old.each(lambda k, t: t.unionByName(getattr(added, k)))
    return merge(both), count_batch(old.messages, added, ids)


def among(column: str, values: list) -> Column:
    """Whether a column has one of the values, as a balanced tree of equalities that Spark pushes into the scan."""
    terms = [F.col(column) == F.lit(v) for v in values] or [F.lit(False)]
    while len(terms) > 1:
        terms = [reduce(operator.or_, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return terms[0]


def looked_up(stored: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The stored rows whose column is among the wanted ones: a few by equalities, many by a join."""
    values = [r[0] for r in wanted.select(column).distinct().limit(LOOKUP + 1).collect()]
    if len(values) <= LOOKUP:
        return stored.where(among(column, [v for v in values if v is not None]))
    return stored.join(wanted.select(column).distinct(), column, "left_semi")


def stats(t: Tables) -> DataFrame:
    """One row: files, messages, attachments (distinct names as given)."""
    return t.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(t.messages.agg(F.count_distinct("key").alias("messages"))).crossJoin(t.file_attachments.agg(F.count_distinct("name").alias("attachments")))


def store_keys(t: Tables) -> DataFrame:
    return t.file_messages.select("file_id", "key").unionByName(t.file_attachments.select("file_id", attachment_key(F.col("name")).alias("key"))).distinct()


def display_names(t: Tables) -> DataFrame:
    """file_id, name: of files that share a name the first keeps it, the others get their id behind it."""
    first = t.files.groupBy("name").agg(F.min("file_id").alias("first"))
    return t.files.join(first, "name").select("file_id", F.when(F.col("file_id") > F.col("first"), F.concat("name", F.lit("#"), F.col("file_id").cast("string"))).otherwise(F.col("name")).alias("name"))


def store_verdict(t: Tables) -> DataFrame:
    return covered(store_keys(t), display_names(t))


def stored_messages(t: Tables) -> DataFrame:
    """Every message with the path of the lowest file id that holds it (empty if none does)."""
    path = t.file_messages.join(t.files.select("file_id", "path"), "file_id").groupBy("key").agg(F.min_by("path", "file_id").alias("path"))
    return t.messages.join(path, "key", "left").withColumn("path", F.coalesce("path", F.lit("")))


def purge(t: Tables) -> Tables:
    """Without the messages that no file holds any more."""
    return Tables(t.files, t.messages.join(t.file_messages.select("key").distinct(), "key", "left_semi"), t.file_messages, t.file_attachments)


class StoreConflict(RuntimeError):
    """Another writer has added a batch meanwhile; nothing of this one was taken in."""


class Store:
    """Parts of the tables in a directory and numbered manifests that say which parts count.

    A manifest appears whole under a number that wasn't there, or not at all, and is never changed: a broken write is
    never seen, and of two writers one fails. Parts that a merge has replaced stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, int]]:
        """(number, time in milliseconds) of the manifests."""
        p, fs = self._fs("manifests")
        if not fs.exists(p):
            return []
        found = [(str(f.getPath().getName()), f.getModificationTime()) for f in fs.listStatus(p)]
        return sorted((int(name[:-5]), at) for name, at in found if name.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def version(self) -> dict | None:
        """The last manifest: number, batch (the name of the last one), parts (name, level), files, messages, top (the largest file_id)."""
        numbers = self._manifests()
        return self._manifest(numbers[-1][0]) if numbers else None

    def parts(self, v: dict | None = None) -> Tables:
        v = v or self.version()
        if v is None or not v["parts"]:
            return Tables.empty(self.spark)
        return self._tables([p["name"] for p in v["parts"]])

    def _tables(self, names: list[str]) -> Tables:
        return Tables(**{k: self.spark.read.schema(s).parquet(*[f"{self.path}/parts/{name}/{k}" for name in names]) for k, s in SCHEMAS.items()})

    def read(self) -> Tables:
        return merge(self.parts())

    def stats(self) -> DataFrame:
        """As stats(read()); files and messages come from the manifest, only the names of attachments are read."""
        v = self.version()
        names = self.read().file_attachments.agg(F.count_distinct("name").alias("attachments"))
        return names.select(*[F.lit(v[k] if v else 0).cast("long").alias(k) for k in ("files", "messages")], "attachments")

    def _write_part(self, t: Tables, ranges: bool = False) -> str:
        name = uuid.uuid4().hex
        for k, by in SORTED.items():
            rows = getattr(t, k)
            rows = (rows.repartitionByRange(by) if ranges else rows).sortWithinPartitions(by)
            bloom = {f"parquet.bloom.filter.enabled#{by}": "true", "parquet.bloom.filter.adaptive.enabled": "true"} if k in ("files", "messages") else {}
            rows.write.options(**bloom).parquet(f"{self.path}/parts/{name}/{k}")
        return name

    def _publish(self, number: int, batch: str | None, parts: list[dict], files: int = 0, messages: int = 0, top: int = -1) -> None:
        """Put a manifest if its number is free. What a file system does in one step: a local one links, one whose rename
        keeps what is there renames, others create the object when the stream is closed unless it exists."""
        manifest, fs = self._fs(f"manifests/{number:012d}.json")
        said = json.dumps({"number": number, "batch": batch, "parts": parts, "files": files, "messages": messages, "top": top}).encode()
        fs.mkdirs(manifest.getParent())
        taken = StoreConflict(f"{self.path}: manifest {number} is there already")
        scheme = str(fs.getScheme())
        if scheme == "file":
            place = str(manifest.toUri().getPath())
            draft = f"{place}.{uuid.uuid4().hex}.draft"
            with open(draft, "xb") as out:
                out.write(said)
            try:
                os.link(draft, place)
            except FileExistsError:
                raise taken from None
            finally:
                os.unlink(draft)
            return
        atomic_rename = scheme in ("hdfs", "viewfs", "abfs", "abfss")
        target = self._fs(f"manifests/{uuid.uuid4().hex}.draft")[0] if atomic_rename else manifest
        if fs.exists(manifest):
            raise taken
        try:
            out = fs.create(target, False)
            out.write(bytearray(said))
            out.close()
        except Exception as failed:
            raise taken from failed
        if atomic_rename and not fs.rename(target, manifest):
            fs.delete(target, False)
            raise taken

    def add(self, batch: DataFrame, files: DataFrame, stamp: str, batch_name: str | None = None) -> dict:
        """Take a batch in and count it; a batch that was the last one already (by name) isn't taken in again."""
        v = self.version() or {"number": 0, "batch": None, "parts": [], "files": 0, "messages": 0, "top": -1}
        if batch_name is not None and v["batch"] == batch_name:
            return {}
        number = v["number"] + 1
        with passing():
            stored = self.parts(v)
            look = looked_up if v["parts"] else lambda nothing, wanted, column: nothing
            files = table(files.select("file_id", "path", "name"), "store-batch-files")
            added, ids = batch_parts(look(stored.files.select("path", "file_id"), files, "path"), v["top"], batch, files, stamp, number)
            part = self._write_part(added)
            written = self._tables([part])
            counts = count_batch(look(stored.messages.select("key"), written.messages, "key"), written, ids).first().asDict()
        totals = {"files": v["files"] + counts["added"], "messages": v["messages"] + counts["messages_added"], "top": v["top"] + counts["added"]}
        self._publish(number, batch_name, [*v["parts"], {"name": part, "level": 0}], **totals)
        self._merge_levels()
        return counts

    def _merge_levels(self) -> None:
        """Merge the parts of each level that has COMPACT of them, from below."""
        v = self.version()
        while True:
            levels: dict[int, list[dict]] = defaultdict(list)
            for p in v["parts"]:
                levels[p["level"]].append(p)
            full = min((k for k, ps in levels.items() if len(ps) >= COMPACT), default=None)
            if full is None:
                return
            v = self._replace(v, levels[full], full + 1)

    def _replace(self, v: dict, merged: list[dict], level: int) -> dict:
        names = [p["name"] for p in merged]
        with passing():
            part = self._write_part(merge(self._tables(names)), ranges=True)
        left = [p for p in v["parts"] if p["name"] not in names]
        self._publish(v["number"] + 1, v["batch"], [{"name": part, "level": level}, *left], v["files"], v["messages"], v["top"])
        return self.version()

    def compact(self) -> None:
        """Merge all parts into one."""
        v = self.version()
        if v is not None and len(v["parts"]) > 1:
            self._replace(v, v["parts"], max(p["level"] for p in v["parts"]) + 1)

    def vacuum(self, retain: float = RETAIN) -> int:
        """Delete the manifests that were replaced more than `retain` seconds ago and the parts that no other one names, and
        say how many parts went. Parts that a writer has begun since then are left alone."""
        found = self._manifests()
        limit = (time.time() - retain) * 1000
        # A manifest holds until the next one appears.
        old = [n for (n, _), (_, replaced) in zip(found, found[1:], strict=False) if replaced < limit]
        kept = [n for n, _ in found if n not in old]
        used = {p["name"] for n in kept for p in self._manifest(n)["parts"]}
        named = {p["name"] for n in old for p in self._manifest(n)["parts"]}
        p, fs = self._fs("parts")
        gone = 0
        for f in fs.listStatus(p) if fs.exists(p) else []:
            name = str(f.getPath().getName())
            if name not in used and (name in named or f.getModificationTime() < limit):
                gone += bool(fs.delete(f.getPath(), True))
        for n in old:
            fs.delete(self._fs(f"manifests/{n:012d}.json")[0], False)
        return gone
