"""The reply forest and the proof that the verdict loses nothing.

A message is known by its message-id, else by its content key. Its parent is the first of In-Reply-To and the
References from last to first that names another message at hand.

Depths, roots and the reading order come from one Euler tour: every message is entered and left once, and each of these
two visits knows the next one. Pointer doubling on that list takes as many rounds as the logarithm of the largest
tree's size, each an equality join on a table of short numbers, however deep the replies go and however many there are
to one message. Messages in a reply cycle have no root, so their list has no end; they are in `stranded`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators.keys import message_key
from strandline.operators.ranking import ranked
from strandline.scratch import table


# What is said of a verdict that was proved.
PROOF, COLLAPSED = "Collapsed %d files -> %d branches; %d unique messages, %d lost.", " (%d cross-format duplicate%s collapsed)"


def identity(messages: DataFrame) -> DataFrame:
    """messages plus key, mid and node (the identity)."""
    rows = messages.withColumn("key", message_key(F.col("sender"), F.col("body"))).withColumn("mid", X.message_ref(F.col("message_id")))
    return rows.withColumn("node", F.when(F.col("mid") != "", F.concat(F.lit("mid:"), "mid")).otherwise(F.concat(F.lit("key:"), F.lower(F.hex("key")))))


def nodes(messages: DataFrame) -> DataFrame:
    """One row for each identity: its earliest message, with ts."""
    rows = identity(messages).withColumn("ts", X.sent_at(F.col("timestamp")))
    best = rows.groupBy("node").agg(F.min_by(F.struct(*messages.columns, "key", "mid", "ts"), F.struct("ts", "file_id", "msg_idx")).alias("row"))
    return best.select("node", "row.*")


def parents(found: DataFrame) -> DataFrame:
    """node, parent: nodes without a parent have no row."""
    refs = F.transform(F.reverse(F.coalesce("references", F.array().cast("array<string>"))), X.message_ref)
    candidates = F.concat(F.array(X.message_ref(F.col("in_reply_to"))), refs)
    asked = found.select("node", F.posexplode(candidates).alias("pos", "mid")).where("mid <> ''")
    known = found.where("mid <> ''").select("mid", F.col("node").alias("target"))
    return asked.join(known, "mid").where("target <> node").groupBy("node").agg(F.min_by("target", "pos").alias("parent"))


def forest(messages: DataFrame) -> DataFrame:
    """root, node, parent, depth, root_place, place and the message.

    Roots stand by time and then subject (root_place), and so do the replies to one message; place counts a tree's
    messages in reading order, from 0: a message, then each of its replies with all that follows from it.
    """
    subject = F.coalesce(F.nullif(X.text(F.col("subject")), F.lit("")), F.lit("(no subject)"))
    found = table(nodes(messages).withColumn("title", subject), "nodes")
    edges = found.select("node", "ts", "title", "file_id", "msg_idx").join(parents(found), "node", "left")
    # One order for all: roots first, then the replies to one message side by side.
    placed = table(ranked(edges, ["parent", "ts", "title", "file_id", "msg_idx"]).select("node", "parent", F.col("ordinal").alias("id")), "placed")
    walked = tour(placed)
    names = placed.select(F.col("node").alias("root"), F.col("id").alias("root_place"))
    out = placed.join(walked, "id").join(names, "root_place").drop("id")
    return out.join(found, "node")


def tour(placed: DataFrame) -> DataFrame:
    """id, root_place (the root's id), depth, place; nodes in a cycle have no row.

    placed: node, parent (null for roots), id: from 1, the children of one parent numbered side by side.
    """
    family = placed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    family = table(family.join(placed.select("node", F.col("id").alias("up")), "node").select("up", "first", "last"), "families")
    rows = placed.select("id", F.col("parent").isNull().alias("is_root"))
    rows = rows.join(family.select(F.col("up").alias("id"), "first"), "id", "left").join(family.select(F.col("last").alias("id"), "up"), "id", "left")
    # Visit 2 id enters, 2 id + 1 leaves. After a message's last reply is left, the message is left.
    enter = F.struct((F.col("id") * 2).alias("visit"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("rise"))
    after = F.when(~F.col("is_root"), F.coalesce(F.col("up") * 2 + 1, F.col("id") * 2 + 2))
    leave = F.struct((F.col("id") * 2 + 1).alias("visit"), after.alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("rise"))
    # entered and rise: sums over the visits from this one up to the next, which is not counted; end: the list's last visit.
    steps = rows.select(F.explode(F.array(enter, leave)).alias("v")).select("v.*").withColumn("end", F.when(F.col("next").isNull(), F.col("visit")))
    steps = table(steps, "tour")
    closed = [steps.where("end is not null")]
    open_before = None
    while True:
        # An open list of any length gets new closed visits in each round; if none closes, the rest are cycles.
        still_open = steps.where("end is null").count()
        if still_open == 0 or still_open == open_before:
            break
        open_before = still_open
        # What is closed is looked up and not written again.
        left = steps.where("end is null")
        every = functools.reduce(DataFrame.unionByName, closed, left)
        ahead = every.select(F.col("visit").alias("next"), F.col("next").alias("next2"), F.col("entered").alias("entered2"), F.col("rise").alias("rise2"), F.col("end").alias("end2"))
        moved = left.join(ahead, "next").select("visit", F.col("next2").alias("next"), (F.col("entered") + F.col("entered2")).alias("entered"), (F.col("rise") + F.col("rise2")).alias("rise"), F.col("end2").alias("end"))
        steps = table(moved, "tour")
        closed.append(steps.where("end is not null"))
    done = functools.reduce(DataFrame.unionByName, closed)
    done = done.where("visit % 2 = 0").select(F.shiftright("visit", 1).alias("id"), F.shiftright("end", 1).alias("root_place"), "entered", "rise")
    whole = done.where("id = root_place").select("root_place", F.col("entered").alias("size"))
    # From a visit to the end: rise is minus the depth, and entered counts the message and all after it.
    return done.join(whole, "root_place").select("id", "root_place", (-F.col("rise")).cast("int").alias("depth"), (F.col("size") - F.col("entered")).alias("place"))


def stranded(messages: DataFrame, walked: DataFrame) -> DataFrame:
    """Messages in reply cycles: no root leads to them."""
    return nodes(messages).join(walked.select("node"), "node", "left_anti")


def forest_lines(walked: DataFrame) -> DataFrame:
    """root_place, place, line: one line of text for each message, indented by depth."""
    stamp = F.when(X.text(F.col("timestamp")) != "", F.concat(F.lit("["), "timestamp", F.lit("] "))).otherwise(F.lit(""))
    bullet = F.when(F.col("depth") > 0, F.lit("- ")).otherwise(F.lit("* "))
    return walked.select("root_place", "place", F.concat(F.repeat(F.lit("  "), F.col("depth")), bullet, stamp, "title", F.lit("  ("), X.who(F.col("sender")), F.lit(")")).alias("line"))


def missing(messages: DataFrame, states: DataFrame) -> DataFrame:
    """node, said, held: the identities that no kept file has; held: whether a kept message says the same under another identity."""
    rows = identity(messages)
    first = rows.groupBy("node").agg(F.min_by(F.struct("key", "sender", "subject"), F.struct("file_id", "msg_idx")).alias("row")).select("node", "row.*")
    kept = rows.join(states.where("not redundant").select("file_id"), "file_id", "left_semi")
    gone = first.join(kept.select("node").distinct(), "node", "left_anti")
    gone = gone.join(kept.select("key").distinct().withColumn("held", F.lit(True)), "key", "left")
    said = F.concat(X.who(F.col("sender")), F.lit(": "), F.coalesce(F.nullif(X.text(F.col("subject")), F.lit("")), F.lit("(no subject)")))
    return gone.select("node", said.alias("said"), F.coalesce("held", F.lit(False)).alias("held"))


def lost(messages: DataFrame, states: DataFrame) -> DataFrame:
    """node, said: messages that no kept file has, nor their content."""
    return missing(messages, states).where("not held").select("node", "said")


def verify_no_loss(messages: DataFrame, states: DataFrame) -> DataFrame:
    """One row: files_total, branches_kept, unique_messages, n_lost, collapsed, ok, line; what is lost, lost() tells.

    lost: identities that no kept file has, nor their content. collapsed: their content is kept under another identity.
    """
    loss = missing(messages, states).agg(F.count_if(~F.col("held")).alias("n_lost"), F.count_if("held").alias("collapsed"))
    total = states.agg(F.count(F.lit(1)).alias("files_total"), F.count_if(~F.col("redundant")).alias("branches_kept"))
    unique = identity(messages).select("node").distinct().agg(F.count(F.lit(1)).alias("unique_messages"))
    out = total.crossJoin(unique).crossJoin(loss)  # one row each
    line = F.format_string(PROOF, "files_total", "branches_kept", "unique_messages", "n_lost")
    more = F.when(F.col("collapsed") > 0, F.format_string(COLLAPSED, "collapsed", F.when(F.col("collapsed") == 1, F.lit("")).otherwise(F.lit("s")))).otherwise(F.lit(""))
    return out.withColumn("ok", F.col("n_lost") == 0).withColumn("line", F.concat(line, more))
