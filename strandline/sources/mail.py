"""Mail files and mailboxes, read with Python's email package in Arrow batches: MIME has no native reader.

Mailboxes are cut into messages by Spark's text source, whose record separator is the line break before a "From " line.
So a mailbox of any size is read in byte ranges by as many tasks as it has splits. A range numbers its own records as it
reads them; they are parsed and written once, and a sum of the ranges' counts then numbers the whole file. Bodies are
neither sorted nor shuffled.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import html
import re
from collections.abc import Callable, Iterator
from email.message import EmailMessage

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.schema import MESSAGE, MESSAGE_FIELDS
from strandline.scratch import table

KINDS = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
#: Messages that are held in Python at once.
AT_ONCE = 16
#: Ranges whose numbers are broadcast; those of more are joined by a shuffle.
FEW_RANGES = 100_000
ENVELOPE = b"From "
#: What the email package raises on headers and parts that are too broken for it.
BROKEN = (LookupError, ValueError, AttributeError, TypeError)


def html_text(page: str) -> str:
    """Tags as spaces, all entities decoded once, lines squeezed, empty lines dropped."""
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in html.unescape(re.sub(r"<[^>]+>", " ", page or "")).splitlines())
    return "\n".join(x for x in lines if x).strip()


@F.pandas_udf(T.StringType())
def html_text_udf(pages: pd.Series) -> pd.Series:
    return pages.fillna("").map(html_text)


@F.pandas_udf(T.StringType())
def _legacy(content: pd.Series) -> pd.Series:
    def read(data: bytes) -> str:
        try:
            return data.decode("cp1252")
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace")

    return content.map(lambda x: "" if x is None else read(bytes(x)))


def decode_legacy(content: Column) -> Column:
    """Windows-1252, else UTF-8 with replacements."""
    return _legacy(content)


# --- one message -----------------------------------------------------------------------------------------------------


def leaves(part: EmailMessage, attached: bool = False) -> Iterator[tuple[EmailMessage, bool]]:
    """A message's single parts in order, and whether each is attached or stands beside the part that it goes with."""
    attached = attached or part.is_attachment()
    if part.get_content_maintype() != "multipart":
        yield part, attached
        return
    inside = part.get_payload()
    for k, p in enumerate(inside if isinstance(inside, list) else []):
        yield from leaves(p, attached or part.get_content_subtype() == "related" and k > 0)


def rank(part: EmailMessage, attached: bool) -> int | None:
    """How good a body a part is, from 0; None if it is no text to read. Attached texts come after all others."""
    kind = {"text/plain": 0, "text/html": 1}.get(part.get_content_type())
    return None if kind is None else kind + 2 * attached


def shown(part: EmailMessage) -> str:
    """A part's text; of an unknown character set as UTF-8."""
    data = part.get_payload(decode=True)
    if not isinstance(data, bytes):
        return ""
    try:
        text = data.decode(part.get_content_charset("ascii"), "replace")
    except LookupError:
        text = data.decode("utf-8", "replace")
    return html_text(text) if part.get_content_type() == "text/html" else text.strip()


def body_of(message: EmailMessage) -> str:
    ranked_parts = [(r, k, p) for k, (p, attached) in enumerate(leaves(message)) if (r := rank(p, attached)) is not None]
    if ranked_parts:
        return shown(min(ranked_parts, key=lambda x: x[:2])[2])
    return "" if message.is_multipart() else shown(message)


def attachments_of(message: EmailMessage) -> list[str]:
    return [name.strip() for p in message.iter_attachments() if (name := p.get_filename())]


def _plain(value: str) -> str:
    return value.strip()


def _wall_clock(value: str) -> str:
    """The date without its offset; as it stands where it can't be read."""
    try:
        return email.utils.parsedate_to_datetime(value).strftime("%Y-%m-%d %H:%M")
    except (TypeError, ValueError):
        return value.strip()


def _ids(value: str) -> list[str]:
    return re.findall(r"<[^>]+>", value) or value.split()


#: Field of a message: the header it is read from and how.
HEADERS: dict[str, tuple[str, Callable]] = {
    "sender": ("From", _plain), "timestamp": ("Date", _wall_clock), "recipient": ("To", _plain), "subject": ("Subject", _plain),
    "message_id": ("Message-ID", _plain), "in_reply_to": ("In-Reply-To", _plain), "references": ("References", _ids),
}
PARTS: dict[str, Callable] = {"attachments": attachments_of, "body": body_of}


def fields_of(data: bytes) -> dict:
    """A message's fields but file_id, name and msg_idx; what is too broken to be read is empty."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    out = {}
    for field, (header, read) in HEADERS.items():
        try:
            out[field] = read(str(message[header] or ""))
        except BROKEN:
            out[field] = read("")
    for field, read in PARTS.items():
        try:
            out[field] = read(message)
        except BROKEN:
            out[field] = [] if field == "attachments" else ""
    return out


def _batch(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    """Messages as schema.MESSAGE. rows: file_id, name, msg_idx, the message's bytes."""
    fields = [{"file_id": i, "name": n, "msg_idx": k, **fields_of(data)} for i, n, k, data in rows]
    valid = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else [valid(y) for y in x] if isinstance(x, list) else x
    return pa.RecordBatch.from_arrays([pa.array([valid(f[c]) for f in fields], t) for c, t in zip(MESSAGE_FIELDS, KINDS, strict=True)], MESSAGE_FIELDS)


# --- files -----------------------------------------------------------------------------------------------------------


def split_mailbox(data: bytes) -> list[bytes]:
    """A mailbox's messages: each from after its "From " line to the next one. What stands before the first is left out."""
    records = (b"\n" + data).split(b"\n" + ENVELOPE)[1:]
    return [r.partition(b"\n")[2] for r in records]


def parse_mail(files: DataFrame) -> DataFrame:
    """Messages of mail files and mailboxes whose bytes are at hand (file_id, name, content, kind: eml or mbox)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, name, content, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = split_mailbox(content or b"") if kind == "mbox" else [content or b""]
                for k in range(0, len(parts), AT_ONCE):
                    yield _batch([(file_id, name, k + j, p) for j, p in enumerate(parts[k : k + AT_ONCE])])

    return files.select("file_id", "name", "content", "kind").mapInArrow(run, MESSAGE)


def mailbox_records(spark: SparkSession, directory: str, recursive: bool, pattern: str) -> DataFrame:
    """path, range (where it starts), data: the records of a directory's mailboxes, in order within a range."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).option("lineSep", "\n" + ENVELOPE.decode())
    rows = reader.text(directory if recursive else f"{directory.rstrip('/')}/*")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # as the lists of files have it
    return rows.select(path.alias("path"), F.col("_metadata.file_block_start").alias("range"), F.expr("cast(value as binary)").alias("data"))


_RECORD = f"{MESSAGE}, path string, range long, opens boolean"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages whose msg_idx counts within their range, and whether a record begins like a message by itself."""
    now, count = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            rows, opens = [], []
            for path, start, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                now, count = (path, start), count + 1 if (path, start) == now else 0
                rows.append((0, "", count, (data or b"").partition(b"\n")[2]))
                opens.append((data or b"").startswith(ENVELOPE))
            out = _batch(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, part.column(0), part.column(1), pa.array(opens, pa.bool_())], [*MESSAGE_FIELDS, "path", "range", "opens"])


def parse_mailboxes(records: DataFrame, files: DataFrame) -> DataFrame:
    """Messages of mailbox_records() whose path is in files (path, name, file_id), numbered along their file.

    A file's first record has no line break before it: it is a message if it begins like one, else it is left out.
    """
    parsed = table(records.mapInArrow(_parsed, _RECORD), "mailbox-records")
    ranges = parsed.groupBy("path", "range").agg(F.count(F.lit(1)).alias("n"), F.min_by("opens", "msg_idx").alias("opens"))
    along = Window.partitionBy("path").orderBy("range")  # a row for each range of a file
    skipped = F.when(F.first("opens").over(along), 0).otherwise(1)
    ranges = ranges.withColumn("before", F.sum("n").over(along) - F.col("n") - skipped).join(files.select("path", "file_id", "name"), "path")
    ranges = table(ranges.select(F.col("path").alias("r_path"), F.col("range").alias("r_range"), "before", F.col("file_id").alias("r_file_id"), F.col("name").alias("r_name")), "mailbox-ranges")
    numbers = F.broadcast(ranges) if ranges.count() <= FEW_RANGES else ranges
    rows = parsed.join(numbers, (F.col("path") == F.col("r_path")) & (F.col("range") == F.col("r_range")))
    place = (F.col("msg_idx") + F.col("before")).cast("int")
    own = {"file_id": F.col("r_file_id"), "name": F.col("r_name"), "msg_idx": place}
    return rows.where(place >= 0).select(*[own.get(c, F.col(c)).alias(c) for c in MESSAGE_FIELDS])
