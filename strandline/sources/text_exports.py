"""Text exports of threads: stacked messages, each a block of header lines and a body.

A block begins at a From: line that is a file's first or follows a blank line; what comes before the first one is left
out. Headers end at a blank line or at a line that is neither a header nor the continuation of one. All is done with
array functions inside a file's row, so files of any number are parsed without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions.text import let
from strandline.schema import MESSAGE_FIELDS


def _starts(lines: Column) -> Column:
    """0-based lines where blocks begin."""
    before = lambda i: F.when(i == 0, F.lit(True)).otherwise(X.strip(F.get(lines, i - 1)) == "")
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("(?i)^from:") & before(i), i)), lambda i: i.isNotNull())


def _blocks(lines: Column) -> Column:
    """The lines of each block."""
    return let(_starts(lines), lambda s: F.transform(s, lambda at, k: F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at)))


def _body_start(block: Column) -> Column:
    """0-based line where the body begins: after the first blank line, or at the first line that is no header or continuation."""
    blank = F.array_min(F.transform(block, lambda x, i: F.when(X.strip(x) == "", i)))
    odd = F.array_min(F.transform(block, lambda x, i: F.when((X.strip(x) != "") & ~x.rlike(X.HEADER) & ~x.rlike("^[ \t]"), i)))
    far = F.size(block)
    return F.when(F.coalesce(blank, far) < F.coalesce(odd, far), blank + 1).otherwise(F.coalesce(odd, far))


def _headers(block: Column, end: Column) -> Column:
    """Array of (key, value) of the header lines, continuations joined on."""
    lines = F.slice(block, F.lit(1), F.greatest(end, F.lit(0)))
    kind = "array<struct<key:string,value:string>>"

    def add(acc: Column, line: Column) -> Column:
        fresh = F.struct(F.lower(F.regexp_extract(line, X.HEADER, 1)).alias("key"), X.strip(F.regexp_extract(line, X.HEADER, 2)).alias("value"))
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["key"].alias("key"), X.strip(F.concat(last["value"], F.lit(" "), X.strip(line))).alias("value"))
        return F.when(line.rlike(X.HEADER), F.concat(acc, F.array(fresh))).when((F.size(acc) > 0) & (X.strip(line) != ""), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(acc)

    return F.aggregate(lines, F.array().cast(kind), add)


def _value(headers: Column, key: str) -> Column:
    """The last value of a header; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(headers, lambda h: h["key"] == key), F.lit(-1))["value"], F.lit(""))


def parse_exports(files: DataFrame) -> DataFrame:
    """Messages of text exports (file_id, name, text), in the order of the file. A text without a From: line has none."""
    blocks = files.select("file_id", "name", F.posexplode(let(X.split_lines(X.text(F.col("text"))), _blocks)).alias("msg_idx", "block"))
    blocks = blocks.withColumn("end", _body_start(F.col("block"))).withColumn("headers", _headers(F.col("block"), F.col("end")))
    h = lambda key: _value(F.col("headers"), key)
    body = X.strip(F.array_join(F.slice("block", F.col("end") + 1, F.size("block")), "\n"))
    fields = {
        "file_id": F.col("file_id"), "name": F.col("name"), "msg_idx": F.col("msg_idx"), "sender": h("from"), "timestamp": F.coalesce(F.nullif(h("sent"), F.lit("")), h("date")), "recipient": h("to"), "subject": h("subject"),
        "attachments": X.split_attachments(h("attachments")), "body": body, "message_id": h("message-id"), "in_reply_to": h("in-reply-to"), "references": X.split_references(h("references")),
    }
    return blocks.select(*[fields[c].alias(c) for c in MESSAGE_FIELDS])


def render_exports(messages: DataFrame) -> DataFrame:
    """file_id, name, text: the export format of each file's messages, by msg_idx. The inverse of parse_exports for
    messages whose fields are stripped and whose bodies hold no block of their own."""
    line = lambda name, c: F.when(X.text(c) != "", F.concat(F.lit(f"{name}: "), X.text(c)))
    joined = lambda c, sep: F.array_join(F.coalesce(c, F.array().cast("array<string>")), sep)
    head = F.concat_ws(
        "\n", F.concat(F.lit("From: "), X.text(F.col("sender"))), line("Sent", F.col("timestamp")), line("To", F.col("recipient")), line("Subject", F.col("subject")), line("Attachments", joined(F.col("attachments"), "; ")),
        line("Message-ID", F.col("message_id")), line("In-Reply-To", F.col("in_reply_to")), line("References", joined(F.col("references"), " ")),
    )
    block = F.concat(head, F.lit("\n\n"), X.text(F.col("body")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", block.alias("block"))))
    return messages.groupBy("file_id", "name").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("text"))
