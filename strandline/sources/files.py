"""Finding and reading exports: which files count, in which order, and their bytes as text.

Files are listed without their content first; PDFs that other messages name as attachments are dropped from that list,
so they are never opened. Order is part of the data: file_id is the place in the order of paths, PDFs after all others.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators.ranking import ranked
from strandline.schema import MESSAGE, MESSAGE_FIELDS
from strandline.scratch import table
from strandline.sources import mail, pdf, text_exports

EXTENSIONS = ("txt", "eml", "mbox")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def list_files(spark: SparkSession, directory: str, recursive: bool = False, pattern: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, length, content: a directory's exports. A pattern takes the place of the extensions."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern or "*.{" + ",".join(extensions) + "}")
    rows = reader.load(directory if recursive else f"{directory.rstrip('/')}/*")
    return rows.select(rows["path"], name_of(rows["path"]).alias("name"), "length", "content")


def with_file_ids(files: DataFrame, start: int = 0) -> DataFrame:
    return ranked(files.select("path", "name"), ["path"]).select("path", "name", (F.col("ordinal") - 1 + start).alias("file_id"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark; where it isn't valid, Windows-1252 (see mail.decode_legacy)."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    return F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")).otherwise(mail.decode_legacy(plain))


KINDS = ("text", "mail", "mailbox", "pdf")


def reader_of(path: Column) -> Column:
    """The reader of a file: one of KINDS, by its extension; unknown ones are read as text exports."""
    ext = extension(path)
    return F.when(ext == "eml", F.lit("mail")).when(ext == "mbox", F.lit("mailbox")).when(ext == "pdf", F.lit("pdf")).otherwise(F.lit("text"))


def parse_files(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Messages of files (file_id, name, path, content), each by its extension. kinds: those of KINDS that occur."""
    of = lambda *kinds: files.where(reader_of(F.col("path")).isin(*kinds))
    parts = []
    if "text" in kinds:
        parts.append(text_exports.parse_exports(of("text").select("file_id", "name", decoded(F.col("content")).alias("text"))))
    if "mail" in kinds or "mailbox" in kinds:
        parts.append(mail.parse_mail(of("mail", "mailbox").select("file_id", "name", "content", extension(F.col("path")).alias("kind"))))
    if "pdf" in kinds:
        parts.append(pdf_messages(table(pdf.read_pdf(of("pdf").select("file_id", "name", "content")), "pdf-text")))
    return functools.reduce(DataFrame.unionByName, parts) if parts else empty_messages(files.sparkSession)


def pdf_messages(pages: DataFrame) -> DataFrame:
    """Messages of PDF texts (file_id, name, text): a thread's messages, or one message with the whole text."""
    parsed = text_exports.parse_exports(pages)
    whole = pages.join(parsed.select("file_id").distinct(), "file_id", "left_anti")
    fields = {"msg_idx": F.lit(0), "subject": F.col("name"), "body": F.col("text"), "attachments": F.array().cast("array<string>"), "references": F.array().cast("array<string>")}
    alone = whole.select(*[fields.get(c, F.col(c) if c in ("file_id", "name") else F.lit("")).alias(c) for c in MESSAGE_FIELDS])
    return parsed.unionByName(alone)


@dataclass
class Reading:
    """messages: schema.MESSAGE. files: path, name, file_id of the inputs. report: path, name, status of everything that was
    found: "read", "no messages", "unreadable" (a PDF with little or no text; it is no input) or "attachment"."""

    messages: DataFrame
    files: DataFrame
    report: DataFrame


def read_directory(spark: SparkSession, directory: str, recursive: bool = False, pattern: str | None = None, include_pdf: bool = True) -> Reading:
    """A directory's exports. PDFs count without a pattern only: those that no message names as an attachment and that
    hold messages. Files of other kinds stay inputs even without any message.
    """
    listed = list_files(spark, directory, recursive, pattern)
    files = table(with_file_ids(listed), "files")
    kinds = {r.kind for r in files.select(reader_of(F.col("path")).alias("kind")).distinct().collect()}  # four at most
    parts = [parse_files(listed.where(reader_of(F.col("path")) != "mailbox").drop("name").join(files, "path"), tuple(kinds - {"mailbox"}))]
    if "mailbox" in kinds:
        boxes = files.where(reader_of(F.col("path")) == "mailbox")
        parts.append(mail.parse_mailboxes(mail.mailbox_records(spark, directory, recursive, pattern or "*.mbox"), boxes))
    # Parsed once and written: no later step carries the readers' plans.
    messages = table(functools.reduce(DataFrame.unionByName, parts), "messages")
    report = _status(files, messages, "no messages")
    if not include_pdf or pattern:
        return Reading(messages, files, report)
    named = messages.select(F.explode("attachments").alias("name")).select(F.lower(X.strip(name_of(F.col("name")))).alias("low")).distinct()
    pdfs = list_files(spark, directory, recursive, "*.pdf")
    own_name = F.lower(X.strip(pdfs["name"]))
    attached = pdfs.select("path", "name").join(named, own_name == named["low"], "left_semi").withColumn("status", F.lit("attachment"))
    wanted = pdfs.select("path", "name").join(named, own_name == named["low"], "left_anti")
    pdf_files = table(with_file_ids(wanted, files.count()), "files")
    from_pdf = table(parse_files(pdfs.drop("name").join(pdf_files, "path"), ("pdf",)), "messages")
    states = _status(pdf_files, from_pdf, "unreadable")
    readable = pdf_files.join(from_pdf.select("file_id").distinct(), "file_id", "left_semi").select("path", "name", "file_id")
    return Reading(messages.unionByName(from_pdf), files.unionByName(readable), report.unionByName(states).unionByName(attached))


def _status(files: DataFrame, messages: DataFrame, otherwise: str) -> DataFrame:
    read = messages.select("file_id").distinct().withColumn("status", F.lit("read"))
    return files.join(read, "file_id", "left").select("path", "name", F.coalesce("status", F.lit(otherwise)).alias("status"))


def read_messages(spark: SparkSession, directory: str, recursive: bool = False, pattern: str | None = None, include_pdf: bool = True) -> tuple[DataFrame, DataFrame]:
    """(messages, files) of read_directory()."""
    found = read_directory(spark, directory, recursive, pattern, include_pdf)
    return found.messages, found.files


def uploads(spark: SparkSession, records: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(file_id, name, path, content; names that were skipped) of upload records {name, content, encoding}.

    base64 content is decoded, names are made safe, of equal names the last counts. Other kinds of files and content that
    is no base64 are skipped. file_id: the order of names, PDFs after all others.
    """
    rows = spark.createDataFrame([(k, r.get("name"), r.get("content"), r.get("encoding")) for k, r in enumerate(records)], "place long, raw string, text string, encoding string")
    body = F.when(F.col("encoding") == "base64", F.try_to_binary(F.coalesce("text", F.lit("")), F.lit("base64"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.withColumn("name", X.safe_name(F.col("raw"))).withColumn("content", body)
    good = extension(F.col("name")).isin(*EXTENSIONS, "pdf") & F.col("content").isNotNull()
    last = rows.where(good).groupBy("name").agg(F.max_by("content", "place").alias("content")).withColumn("late", extension(F.col("name")) == "pdf")
    files = ranked(last, ["late", "name"])
    return files.select((F.col("ordinal") - 1).alias("file_id"), "name", F.col("name").alias("path"), "content"), rows.where(~good).select(F.coalesce("raw", "name").alias("name"))


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGE)
