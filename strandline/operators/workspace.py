"""The working set behind an interactive session: uploaded files, their verdict, a timeline of a selection, one file's view.

All functions take and return DataFrames; strandline.web puts them behind HTTP.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import contain, timeline, unique
from strandline.operators.keys import file_keys, key_id, with_keys
from strandline.scratch import table
from strandline.sources.files import extension, parse_files, reader_of, uploads

# The errors of an empty selection and of a name that no file has, and what is said of a selection.
NOTHING_SELECTED, NO_SUCH_FILE = "No threads selected.", "No such file."
SUBTITLE = "%d selected file(s); %d unique message(s) after dedup (%d duplicate%s collapsed)."
SOURCE = "/source"


@dataclass
class WorkingSet:
    """messages: schema.MESSAGE. inputs: file_id, name of the files that count. files: file_id, name, content of all uploads."""

    messages: DataFrame
    inputs: DataFrame
    files: DataFrame


def working_set(spark: SparkSession, records: list[dict]) -> tuple[WorkingSet, DataFrame]:
    """(working set, names that were skipped) of upload records {name, content, encoding}; see sources.files.uploads.

    A PDF that a message names as an attachment, and one that can't be read, is a file but no input.
    """
    files, skipped = uploads(spark, records)
    files = table(files, "uploads")
    is_pdf = extension(F.col("name")) == "pdf"
    kinds = {r.kind for r in files.select(reader_of(F.col("name")).alias("kind")).distinct().collect()}  # four at most
    own = table(parse_files(files.where(~is_pdf), tuple(kinds - {"pdf"})), "messages")
    inputs = files.where(~is_pdf).select("file_id", "name")
    if "pdf" in kinds:
        named = own.select(F.explode("attachments").alias("a")).select(F.lower(X.strip(F.regexp_extract("a", "([^/]*)$", 1))).alias("low")).distinct()
        loose = files.where(is_pdf).join(named, F.lower("name") == F.col("low"), "left_anti")
        pages = table(parse_files(loose, ("pdf",)), "messages")
        inputs = inputs.unionByName(loose.select("file_id", "name").join(pages.select("file_id").distinct(), "file_id", "left_semi"))
        own = own.unionByName(pages)
    return WorkingSet(own, inputs, files), skipped


def names_given(names: Column) -> Column:
    """Attachment names without blanks around them; blank ones left out."""
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: X.strip(X.text(x))), lambda x: x != "")


def file_states(messages: DataFrame, inputs: DataFrame) -> DataFrame:
    """name, messages, attachments (distinct names in order), redundant, covered_by: what a session shows of each file."""
    verdict = contain.covered(file_keys(messages), inputs)
    count = messages.groupBy("file_id").agg(F.count(F.lit(1)).alias("messages"))
    names = messages.select("file_id", F.explode(names_given(F.col("attachments"))).alias("a")).distinct().groupBy("file_id").agg(F.array_sort(F.collect_list("a")).alias("attachments"))
    rows = verdict.join(count, "file_id", "left").join(names, "file_id", "left")
    return rows.select("file_id", "name", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments"), "redundant", "covered_by")


def summary(messages: DataFrame, states: DataFrame) -> DataFrame:
    """One row: files, kept, redundant, unique_messages, duplicates."""
    counts = states.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("redundant")).alias("kept"), F.count_if("redundant").alias("redundant"))
    return counts.crossJoin(unique.duplicate_counts(messages).select("unique_messages", "duplicates"))  # one row each


def selected(messages: DataFrame, names: DataFrame) -> DataFrame:
    """The messages of the files that are chosen. names: name."""
    return messages.join(names.select("name").distinct(), "name", "left_semi").select(*messages.columns)


def linked(events: DataFrame, files: DataFrame, base: str = SOURCE) -> DataFrame:
    """events with attachments as array<struct<name, href>>: a link where a file of that name is at hand, else null.

    events need tab and pos, which tell them apart. files: name.
    """
    names = F.transform(F.coalesce("attachments", F.array().cast("array<string>")), lambda x: X.text(x))
    one = events.select("tab", "pos", F.posexplode(names).alias("k", "a")).withColumn("base", F.regexp_extract("a", "([^/]*)$", 1))
    known = files.select(F.col("name").alias("base")).where("base <> ''").distinct().withColumn("href", F.concat(F.lit(base.rstrip("/") + "/"), quoted(F.col("base"))))
    chips = one.join(known, "base", "left").groupBy("tab", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "a", "href"))).alias("chips"))
    none = F.array().cast("array<struct<name:string,href:string>>")
    chips = chips.select("tab", "pos", F.transform("chips", lambda c: F.struct(c["a"].alias("name"), c["href"].alias("href"))).alias("attachments"))
    return events.drop("attachments").join(chips, ["tab", "pos"], "left").withColumn("attachments", F.coalesce("attachments", none))


def quoted(c: Column) -> Column:
    """Text as a part of a URL."""
    out = F.url_encode(c)
    for written, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return out


def build(working: WorkingSet, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of the selected files' unique messages, one row: ok, error, files, count, duplicates, subtitle)."""
    chosen = working.inputs.join(names.select("name").distinct(), "name", "left_semi")
    messages = selected(working.messages, names)
    one = unique.unique_messages(messages).withColumn("path", F.col("name"))
    events = linked(timeline.message_events(one, "conversations", link_base=SOURCE), working.files)
    counts = chosen.agg(F.count(F.lit(1)).alias("files")).crossJoin(unique.duplicate_counts(messages))  # one row each
    s = lambda c: F.when(F.col(c) == 1, F.lit("")).otherwise(F.lit("s"))
    said = F.format_string(SUBTITLE, "files", "unique_messages", "duplicates", s("duplicates"))
    ok = F.col("files") > 0
    report = counts.select(ok.alias("ok"), F.when(~ok, F.lit(NOTHING_SELECTED)).alias("error"), "files", F.when(ok, F.col("unique_messages")).alias("count"), F.when(ok, F.col("duplicates")).alias("duplicates"), F.when(ok, said).alias("subtitle"))
    return events, report


def file_view(messages: DataFrame, name: str) -> DataFrame:
    """msg_idx, sender, recipient, timestamp, subject, body, attachments, key_id of one file's messages, in order; no rows if there is no such file."""
    rows = with_keys(messages.where(F.col("name") == F.lit(name)))
    return rows.select("msg_idx", "sender", "recipient", "timestamp", "subject", "body", names_given(F.col("attachments")).alias("attachments"), key_id(F.col("key")).alias("key_id")).orderBy("msg_idx")


def compare(messages: DataFrame, keeper: str, other: str) -> DataFrame:
    """kind (message or attachment), msg_idx, value, only_here: what the keeper holds and whether the other file lacks it.

    value: a message's key_id, or an attachment's name in lower case; msg_idx: the message that holds it.
    """
    rows = with_keys(messages.where(F.col("name").isin(keeper, other)))
    said = rows.select("name", F.lit("message").alias("kind"), "msg_idx", key_id(F.col("key")).alias("value"))
    held = rows.select("name", F.lit("attachment").alias("kind"), "msg_idx", F.explode(F.transform(names_given(F.col("attachments")), F.lower)).alias("value"))
    both = said.unionByName(held)
    theirs = both.where(F.col("name") == F.lit(other)).select("kind", "value").distinct().withColumn("shared", F.lit(True))
    mine = both.where(F.col("name") == F.lit(keeper)).drop("name")
    return mine.join(theirs, ["kind", "value"], "left").select("kind", "msg_idx", "value", F.col("shared").isNull().alias("only_here"))


class Workspace:
    """The uploads of a session and what was made of them last."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.reset()

    def reset(self) -> None:
        self.records: list[dict] = []
        self.page: str | None = None
        self._working: WorkingSet | None = None

    def save(self, records: list[dict]) -> tuple[int, list[str]]:
        """(number of files taken, names skipped). A file of a name that is there already takes its place."""
        skipped = [r.name for r in uploads(self.spark, records)[1].collect()]
        self.records += records
        self._working = None
        return len(records) - len(skipped), skipped

    def working(self) -> WorkingSet:
        if self._working is None:
            self._working = working_set(self.spark, self.records)[0]
        return self._working
