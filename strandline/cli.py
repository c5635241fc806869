"""Commands: dedup, tree, store, timeline, timeline-threads, ingest, organize, web. Results go to standard output or a file.

Exit codes: 0 done, 1 no files, 2 a classifier's error, 3 the verdict would lose messages.
"""

from __future__ import annotations

import argparse
import importlib
import os
import re
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import strandline
from strandline.functions import text as X
from strandline.operators import contain, forest, organize, store, timeline, unique
from strandline.operators.keys import file_keys
from strandline.plans import render
from strandline.scratch import table
from strandline.session import session
from strandline.sources.files import read_directory

NO_FILES = "No message files found."


def say(text: str) -> None:
    """Print; characters that the terminal can't show are replaced."""
    encoding = sys.stdout.encoding or "utf-8"
    print(text.encode(encoding, "replace").decode(encoding))


def print_verdict(states: DataFrame, unreadable: list[str] = ()) -> int:
    states = table(states, "listed")
    counts = {r.redundant: r.n for r in states.groupBy("redundant").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        say(NO_FILES)
        return 1
    for title, wanted in (("KEEP", False), ("DELETE", True)):
        say(f"{title} ({counts.get(wanted, 0)})")
        for r in states.where(F.col("redundant") == wanted).orderBy("name").toLocalIterator():  # one partition at a time
            note = "  (unreadable: no messages)" if r.n_keys == 0 else f"  covered by {', '.join(r.covered_by)}" if wanted else ""
            say(f"  {r.name}{note}")
    for name in unreadable:
        say(f"not read: {name} (a PDF with little or no text)")
    say("This is a recommendation: no files were deleted.")
    return 0


def directory_of(path: str) -> str:
    """A directory as paths have it that Spark reads: absolute, with its scheme."""
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def folders(rows: DataFrame, directory: str) -> DataFrame:
    """rows (path) with folder (empty for files right in the directory, the sub-directory for files right in one) and
    without rows of files that lie deeper."""
    top = directory if "://" in directory and not directory.startswith("file:") else directory.removeprefix("file://")
    below = F.substr(X.local_path(F.col("path")), F.lit(len(top) + 2))
    parts = F.split(below, "/")
    return rows.where(F.size(parts) <= 2).withColumn("folder", F.when(F.size(parts) == 2, parts[0]).otherwise(F.lit("")))


def folder_events(messages: DataFrame, files: DataFrame, directory: str, link_base: str | None = None) -> tuple[DataFrame, dict[str, str], dict]:
    """(events, labels of tabs, numbers for the subtitle) of a directory: a tab for each sub-directory that has files, and
    files beside them don't count; one tab if none has."""
    rows, known = folders(messages, directory), folders(files, directory)
    several = known.where("folder <> ''").limit(1).count() > 0
    rows, known = (x.where("folder <> ''" if several else "folder = ''") for x in (rows, known))
    counts = unique.folder_counts(rows).agg(F.sum("total").alias("total"), F.sum("unique_messages").alias("one")).first()
    numbers = {"folders": known.select("folder").distinct().count(), "files": known.count(), "unique": counts.one or 0, "duplicates": (counts.total or 0) - (counts.one or 0)}
    if not several:
        return timeline.message_events(unique.unique_messages(rows), "conversations", directory, link_base), {"conversations": "Conversations"}, numbers
    labels = {r.tab: r.label for r in timeline.tab_labels(known).select(X.slug(F.col("folder")).alias("tab"), "label").collect()}  # a row for each sub-directory
    one = unique.unique_messages(rows.withColumn("tab", X.slug(F.col("folder"))), ("tab",)).select("key", "tab", "sender", "timestamp", "recipient", "subject", "attachments", "body", "path", "ts", "first_seen")
    return timeline.message_events(one, directory=directory, link_base=link_base, tab_col="tab"), labels, numbers


def _transport(path: str | None) -> Callable[[dict], dict] | None:
    """The function that MODULE:NAME names; a service's client is the caller's to give."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    p.add_argument("--version", action="version", version=f"strandline {strandline.__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dedup", "tree", "timeline-threads", "ingest", "organize"):
        c = sub.add_parser(name)
        c.add_argument("directory")
        c.add_argument("--recursive", action="store_true", default=name == "organize")
        c.add_argument("--pattern")
        if name not in ("dedup", "tree"):
            c.add_argument("--title")
            c.add_argument("--link-base")
            c.add_argument("-o", "--output", default="events.json" if name == "ingest" else "timeline.html")
        if name == "organize":
            c.add_argument("--classifier", help="MODULE:FUNCTION that sends a request's body to a service and returns the response")
            c.add_argument("--model", default="default")
            c.add_argument("--draft")
    c = sub.add_parser("timeline")
    c.add_argument("events")
    c.add_argument("--title")
    c.add_argument("-o", "--output", default="timeline.html")
    c = sub.add_parser("store")
    c.add_argument("action", choices=["add", "stats", "dedup", "timeline"])
    c.add_argument("store")
    c.add_argument("directory", nargs="?")
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--pattern")
    c.add_argument("-o", "--output", default="timeline.html")
    c = sub.add_parser("web")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8765)
    return p


def main(args: list[str] | None = None, transport: Callable[[dict], dict] | None = None) -> int:
    """transport: for organize, in place of --classifier."""
    a = parser().parse_args(args)
    spark = session("strandline")
    if a.command == "web":
        from strandline.web import serve

        return serve(spark, a.host, a.port)
    if a.command == "timeline":
        d = render.load_document(spark, a.events)
        say(f"Wrote {render.write_timeline(a.output, a.title or d.title, d.events, d.declared, d.subtitle, tabs=d.tabs)} events to {a.output}")
        return 0
    if a.command == "store":
        return store_command(spark, a)
    directory = directory_of(a.directory)
    found = read_directory(spark, directory, a.recursive or a.command in ("timeline-threads", "ingest"), a.pattern, include_pdf=a.command in ("dedup", "tree"))
    n_files = found.files.count()
    if not n_files:
        say(NO_FILES)
        return 1
    if a.command == "dedup":
        unreadable = [r.name for r in found.report.where("status = 'unreadable'").orderBy("name").collect()]
        return print_verdict(contain.covered(file_keys(found.messages), found.files.select("file_id", "name")), unreadable)
    if a.command == "tree":
        return tree_command(found.messages, found.files)
    messages = found.messages.join(found.files.select("file_id", "path"), "file_id")
    if a.command == "organize":
        return organize_command(messages, n_files, directory, a, organize.service(transport or _transport(a.classifier), a.model))
    events, labels, n = folder_events(messages, found.files, directory, a.link_base)
    s = lambda k: "" if n[k] == 1 else "s"
    subtitle = f"{n['files']} file{s('files')}, {n['unique']} unique message{s('unique')}, {n['duplicates']} duplicate{s('duplicates')} collapsed"
    title = a.title or f"Threads: {os.path.basename(directory)}"
    say(subtitle)
    if a.command == "ingest":
        render.write_draft(a.output, render.draft(title, events, subtitle, tabs=timeline.conversation_tabs(events, spark.createDataFrame([(t, x, re.sub(render.NUMBER, "", x)) for t, x in labels.items()], "tab string, label string, heading string"))))
        say(f"Wrote a draft to {a.output}; edit it, then: strandline timeline {a.output}")
        return 0
    say(f"Wrote {render.write_timeline(a.output, title, events, None, subtitle, labels)} events to {a.output}")
    return 0


def store_command(spark: SparkSession, a: argparse.Namespace) -> int:
    s = store.Store(spark, directory_of(a.store))
    if a.action == "add":
        found = read_directory(spark, directory_of(a.directory), a.recursive, a.pattern, include_pdf=False)
        if found.files.limit(1).count() == 0:
            say(NO_FILES)
            return 1
        say(str(s.add(found.messages, found.files, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))))
    elif a.action == "stats":
        say(str(s.stats().first().asDict()))
    elif a.action == "dedup":
        return print_verdict(store.store_verdict(s.read()))
    else:
        rows = store.stored_messages(s.read()).withColumn("first_seen", F.col("seen_seq"))
        say(f"Wrote {render.write_timeline(a.output, 'Message store', timeline.message_events(rows))} events to {a.output}")
    return 0


def tree_command(messages: DataFrame, files: DataFrame) -> int:
    walked = table(forest.forest(messages), "forest")
    say(f"{walked.where('depth = 0').count()} conversations in {files.count()} files")
    for r in forest.forest_lines(walked).orderBy("root_place", "place").toLocalIterator():
        say(r.line)
    states = table(contain.redundancy(file_keys(messages), files.select("file_id", "name")), "states")
    report = forest.verify_no_loss(messages, states).first()
    say(report.line)
    if report.ok:
        say("Every message survives in a kept file.")
        return 0
    say("Messages that the verdict would lose:")
    for r in forest.lost(messages, states).orderBy("said").toLocalIterator():
        say(f"  {r.said}")
    return 3


def organize_command(messages: DataFrame, n_files: int, directory: str, a: argparse.Namespace, classify: Callable[[list[dict]], dict] | None) -> int:
    inputs = table(organize.classifier_inputs(unique.unique_messages(messages)), "inputs")
    n = inputs.count()
    say(f"{n_files} files, {n} unique messages")
    try:
        answer = organize.classify_messages(inputs, classify)
    except organize.ClassifierError as error:
        say(f"Not organized: {error}. A draft without categories: strandline ingest {a.directory}")
        return 2
    categories, assignments = organize.classification_frames(messages.sparkSession, answer)
    events = organize.categorized_events(inputs, categories, assignments, directory, a.link_base)
    title = a.title or answer.title or f"Threads: {os.path.basename(directory)}"
    used = categories.count() + (1 if events.where(F.col("category") == organize.UNCATEGORIZED).limit(1).count() else 0)
    subtitle = f"{used} categories, {n} messages"
    declared = categories.select("id", "label", "color", "ordinal")
    if a.draft:
        render.write_draft(a.draft, render.draft(title, events, subtitle, declared))
        say(f"Wrote a draft to {a.draft}")
    say(subtitle)
    say(f"Wrote {render.write_timeline(a.output, title, events, declared, subtitle)} events to {a.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
