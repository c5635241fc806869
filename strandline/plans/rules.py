"""Queries of single rules and views, each with its SQL: what catalog.py's larger queries don't show column by column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text as X
from strandline.operators import contain, forest, organize, store, timeline, unique, workspace
from strandline.plans.catalog import _ATT, _UNIQUE_SQL, _keys, _stored, _with, query
from strandline.plans.fixtures import EVENTS_SQL, PAIRS_SQL, exports, exports_sql, read, timeline_events
from strandline.sources import files as sources
from strandline.sources import mail, pdf

FULL = [("full", "true", 0)]


def _pick(values: list, k):
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _chosen(values: list, k: str) -> str:
    return f"({_list(values)})[{k} % {len(values)} + 1]"


# --- rules -----------------------------------------------------------------------------------------------------------

_LISTS = ["a.pdf; b.PDF ,, c", " ; ", "one"]
_REFS = ["<1@x> and <2@x>", " 1@x\t2@x ", ""]


@query("header_lists", f"""SELECT conv_id, turn, {_chosen(["a.pdf|b.PDF|c", "", "one"], "turn")} AS attachments, {_chosen(["<1@x>|<2@x>", "1@x|2@x", ""], "turn")} AS refs, {_chosen(["1@x", "1@x\t2@x", ""], "turn")} AS ref FROM conversations""")
def header_lists(spark, sf_dir):
    c, k = read(spark, sf_dir, "conversations"), F.col("turn")
    refs = _pick(_REFS, k)
    return c.select("conv_id", "turn", F.array_join(X.split_attachments(_pick(_LISTS, k)), "|").alias("attachments"), F.array_join(X.split_references(refs), "|").alias("refs"), X.message_ref(refs).alias("ref"))


@query("people", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(role) || ' R → BOB@x.example' ELSE lower(role) || '@x.example' END AS parties, CASE WHEN turn % 2 = 0 THEN upper(role) || ' R' ELSE lower(role) || '@x.example' END AS who FROM conversations""")
def people(spark, sf_dir):
    c, even = read(spark, sf_dir, "conversations"), F.col("turn") % 2 == 0
    sender = F.when(even, F.concat(F.upper("role"), F.lit(" R <Someone@x.example>"))).otherwise(F.concat(F.lit("<"), F.upper("role"), F.lit("@X.example>")))
    who = F.when(even, X.who(sender)).otherwise(F.lower(X.who(sender)))
    return c.select("conv_id", "turn", X.parties(sender, F.when(even, F.lit("BOB@x.example"))).alias("parties"), who.alias("who"))


_FOLDERS = ["01_first-part", "2 - o'neil 3d-x", "007", "plain"]


@query("labels_of_folders", f"""SELECT conv_id, {_chosen(["First Part", "O'Neil 3D X", "007", "Plain"], "conv_id")} AS tab_label, {_chosen(["01 First Part", "2 O'Neil 3D X", "007", "Plain"], "conv_id")} AS pretty, {_chosen(["01-first-part", "2-o-neil-3d-x", "007", "plain"], "conv_id")} AS slug FROM (SELECT DISTINCT conv_id FROM conversations)""")
def labels_of_folders(spark, sf_dir):
    folder = _pick(_FOLDERS, F.col("conv_id"))
    pretty = X.squeeze(X.prettify(folder))
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", X.tab_label(folder).alias("tab_label"), pretty.alias("pretty"), X.slug(folder).alias("slug"))


_SAFE = {
    "color": (["#1e88e5", "red;}", "rgb(1, 2, 3)", "url(x)", " Teal "], ["#1e88e5", None, "rgb(1, 2, 3)", None, "Teal"]),
    "href": (["https://x.example/a", " JavaScript:alert(1)", "data:text/html,x", "/local", "mailto:a@b"], ["https://x.example/a", None, None, "/local", "mailto:a@b"]),
    "name": (["../a b?.txt", "c:\\dir\\x.eml", "...", "", "ok-1_2.mbox"], ["a_b_.txt", "x.eml", "upload", "upload", "ok-1_2.mbox"]),
    "tint": (["#fff", "#1E88E5", "red", "#12", "abc"], ["rgba(255,255,255,0.14)", "rgba(30,136,229,0.14)", "rgba(107,114,128,0.14)", "rgba(107,114,128,0.14)", "rgba(170,187,204,0.14)"]),
    "short": (["2025-03-04", "2025/3/4", "2025-03", "2025", "soon"], ["Mar 4", "Mar 4", "Mar 1", "Jan 1", "soon"]),
    "year": (["2025-03-04", "2025/3/4", "2025-03", "2025", "soon"], ["2025", "2025", "2025", "2025", ""]),
    "sent": (["2025-03-04 9:05", "2025/03/04\t10:00", "on 2025/03/04, 9:05", "2025-02-31", "2025-3-4"], ["2025-03-04 09:05:00", "2025-03-04 10:00:00", "2025-03-04 00:00:00", "9999-12-31 23:59:59.999999", "2025-03-04 00:00:00"]),
    "link": (["file:/d/a b.txt", "/d/sub/x.eml", "hdfs://h/x", "rel.txt", "file:///d/y"], ["/b/a b.txt", "/b/sub/x.eml", "/b/hdfs://h/x", "/b/rel.txt", "/b/y"]),
    "local": (["file:/d/a b.txt", "/d/sub/x.eml", "hdfs://h/x", "rel.txt", "file:///d/y"], ["file:///d/a b.txt", "file:///d/sub/x.eml", "hdfs://h/x", "file:///rel.txt", "file:///d/y"]),
}


@query("safe_values", "SELECT event_id, " + ", ".join(f"{_chosen(out, 'event_id')} AS {name}" for name, (_, out) in _SAFE.items()) + " FROM events")
def safe_values(spark, sf_dir):
    rules = {
        "color": X.safe_color, "href": X.safe_href, "name": X.safe_name, "tint": lambda c: X.tint(c, "0.14"), "short": lambda c: X.short_date(c)[0], "year": lambda c: X.short_date(c)[1],
        "sent": lambda c: X.sent_at(c).cast("string"), "link": lambda c: X.href_for(c, "/d", "/b"), "local": lambda c: X.href_for(c, "/d"),
    }
    return read(spark, sf_dir, "events").select("event_id", *[rules[k](_pick(given, F.col("event_id"))).alias(k) for k, (given, _) in _SAFE.items()])


# --- files and sessions ----------------------------------------------------------------------------------------------


def _attached(spark, sf_dir):
    m = exports(spark, sf_dir, _ATT)
    tag = F.regexp_extract("name", "_(att[ab])", 1)
    return m.withColumn("attachments", F.when((tag != "") & (F.col("msg_idx") == 0), F.array(F.concat(F.upper(tag), F.lit(".PDF ")), F.lit(" "), F.lit("z.txt"))).otherwise(F.col("attachments")))


_BOTH_SQL = "both_ AS (SELECT name, k FROM exports UNION ALL SELECT DISTINCT name, 'att' || chr(2) || regexp_extract(name, '_(att[ab])', 1) FROM exports WHERE name LIKE '%att%' UNION ALL SELECT DISTINCT name, 'att' || chr(2) || x FROM exports, (SELECT unnest(['z.txt', '']) AS x) WHERE name LIKE '%att%')"


@query("file_states", _with(exports_sql(_ATT), _BOTH_SQL, PAIRS_SQL.replace("FROM exports", "FROM both_")) + """
SELECT s.name, (SELECT count(*) FROM exports e WHERE e.name = s.name) AS messages, CASE WHEN s.name LIKE '%att%' THEN upper(regexp_extract(s.name, '_(att[ab])', 1)) || '.PDF,z.txt' ELSE '' END AS attachments, redundant FROM states s""")
def file_states(spark, sf_dir):
    m = _attached(spark, sf_dir)
    return workspace.file_states(m, _keys(m)[1]).select("name", "messages", F.array_join("attachments", ",").alias("attachments"), "redundant")


@query("selection", _with(exports_sql()) + ", c AS (SELECT * FROM exports WHERE name LIKE '%early%') SELECT true AS ok, count(DISTINCT name) AS files, count(DISTINCT k) AS count, count(*) - count(DISTINCT k) AS duplicates FROM c")
def selection(spark, sf_dir):
    m = exports(spark, sf_dir)
    inputs = m.select("file_id", "name").distinct()
    report = workspace.build(workspace.WorkingSet(m, inputs, inputs), inputs.where("name like '%early%'"))[1]
    return report.select("ok", "files", "count", "duplicates")


@query("file_view", _with(exports_sql()) + " SELECT CAST(turn AS INTEGER) AS msg_idx, sender, ts AS timestamp, subject, body FROM exports WHERE name = (SELECT min(name) FROM exports WHERE name LIKE '%tzdup%')")
def file_view(spark, sf_dir):
    m = exports(spark, sf_dir)
    name = m.where("name like '%tzdup%'").agg(F.min("name")).first()[0]  # the file that is viewed
    return workspace.file_view(m, name or "").select("msg_idx", "sender", "timestamp", "subject", "body")


@query("compare_files", _with(exports_sql(_ATT)) + """, f AS (SELECT * FROM exports WHERE conv_id = (SELECT min(conv_id) FROM exports)),
held AS (SELECT DISTINCT name, unnest([regexp_extract(name, '_(att[ab])', 1) || '.pdf', 'z.txt']) AS v FROM f WHERE name LIKE '%att%')
SELECT 'message' AS kind, CAST(turn AS INTEGER) AS msg_idx, k NOT IN (SELECT k FROM f o WHERE o.name LIKE '%attb%') AS only_here FROM f WHERE name LIKE '%atta%'
UNION ALL SELECT 'attachment', 0, v NOT IN (SELECT v FROM held WHERE name LIKE '%attb%') FROM held WHERE name LIKE '%atta%'""")
def compare_files(spark, sf_dir):
    """One file beside another: the same messages, one attachment of its own."""
    m = _attached(spark, sf_dir)
    first = m.agg(F.min("conv_id")).first()[0] or 0  # the pair that is compared
    return workspace.compare(m, f"conv_{first:06d}_atta.txt", f"conv_{first:06d}_attb.txt").select("kind", "msg_idx", "only_here")


@query("linked_attachments", _with(EVENTS_SQL) + """
SELECT tab, pos, category || '.pdf,dir/a b.txt' AS names, CASE WHEN category < 'm' THEN '/source/' || category || '.pdf' ELSE '' END || ',/source/a%20b.txt' AS hrefs FROM tl""")
def linked_attachments(spark, sf_dir):
    e = timeline_events(spark, sf_dir).withColumn("attachments", F.array(F.concat("category", F.lit(".pdf")), F.lit("dir/a b.txt")))
    files = e.where("category < 'm'").select(F.concat("category", F.lit(".pdf")).alias("name")).distinct().unionByName(spark.range(1).select(F.lit("a b.txt").alias("name")))
    part = lambda k: F.array_join(F.transform("attachments", lambda a: F.coalesce(a[k], F.lit(""))), ",").alias(f"{k}s")
    return workspace.linked(e, files).select("tab", "pos", part("name"), part("href"))


@query("mailbox_split", "SELECT conv_id, CAST(turn AS INTEGER) AS msg_idx, role AS sender, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn) FROM conversations)")
def mailbox_split(spark, sf_dir):
    m = exports(spark, sf_dir, FULL)
    one = F.concat(F.lit("From x\nFrom: "), "sender", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.col("body").cast("binary")), F.lit("\n\n"))
    boxes = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", one.alias("m")))), lambda x: x["m"]), "").alias("text"))
    files = boxes.select(F.col("conv_id").alias("file_id"), F.lit("box").alias("name"), F.col("text").cast("binary").alias("content"), F.lit("mbox").alias("kind"))
    return mail.parse_mail(files).select(F.col("file_id").alias("conv_id"), "msg_idx", "sender", "body")


@query("mail_parts", "SELECT conv_id, turn, 'Jörg' || turn AS sender, '2025-01-06 09:30' AS timestamp, 'notes ' || turn || '.pdf' AS attachments, 'Hi you & ' || role AS body, '<' || conv_id || '@x>|<r@x>' AS refs FROM conversations")
def mail_parts(spark, sf_dir):
    """Messages of an HTML body and an attachment, with encoded headers."""
    m = exports(spark, sf_dir, FULL)
    said = F.concat(
        F.lit("From: =?utf-8?q?J=C3=B6rg"), "turn", F.lit("?=\nDate: Mon, 6 Jan 2025 09:30:00 -0800\nReferences: <"), "conv_id", F.lit("@x>\n <r@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n"),
        F.lit("--b\nContent-Type: text/html; charset=x-unknown\n\n<p>Hi&nbsp;<b>you</b> &amp; "), "sender", F.lit("</p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"notes "), "turn", F.lit(".pdf\"\n\nx\n--b--\n"),
    )
    files = m.select((F.col("conv_id") * 100 + F.col("turn")).alias("file_id"), "name", said.cast("binary").alias("content"), F.lit("eml").alias("kind"))
    body = F.regexp_replace(F.replace("body", F.lit("\xa0"), F.lit(" ")), " +", " ")
    return mail.parse_mail(files).select(F.expr("file_id div 100").alias("conv_id"), (F.col("file_id") % 100).alias("turn"), "sender", "timestamp", F.array_join("attachments", "|").alias("attachments"), body.alias("body"), F.array_join("references", "|").alias("refs"))


@query("pdf_literals", "SELECT conv_id, turn, 'From: ' || role || chr(10) || 'a (nested) \\ and A' || chr(10) || chr(10) || 'last line of ' || turn AS body FROM conversations")
def pdf_literals(spark, sf_dir):
    """Literal strings with escapes, nested brackets and octal codes, shown by several operators; the name stands in the text of an array."""
    page = F.concat(F.lit("%PDF\nstream\nBT (From: ) Tj ["), F.concat(F.lit("("), "role", F.lit(")")), F.lit(" 20 ()] TJ T* (a (nested) \\\\ and \\101) Tj T* T* (last line) Tj ( of "), F.col("turn").cast("string"), F.lit(") Tj ET\nendstream\n"))
    files = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("file_id"), F.lit("x.pdf").alias("name"), page.cast("binary").alias("content"))
    return pdf.read_pdf(files).select(F.expr("file_id div 100").alias("conv_id"), (F.col("file_id") % 100).alias("turn"), F.col("text").alias("body"))


@query("decoded_bytes", f"SELECT conv_id, turn, {_chosen(['é – plain', 'é marked', 'é legacy'], 'turn')} || role AS text FROM conversations")
def decoded_bytes(spark, sf_dir):
    c, k = read(spark, sf_dir, "conversations"), F.col("turn") % 3
    utf8 = lambda t: F.concat(F.lit(t), "role").cast("binary")
    content = F.when(k == 0, utf8("é – plain")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8("é marked"))).otherwise(F.encode(F.concat(F.lit("é legacy"), "role"), "iso-8859-1"))
    return c.withColumn("content", content).select("conv_id", "turn", sources.decoded(F.col("content")).alias("text"))


# --- forest ----------------------------------------------------------------------------------------------------------


@query("reply_order", _with(exports_sql(FULL)) + """
SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id) AS root_place, turn - min(turn) OVER (PARTITION BY conv_id) AS place,
       repeat('  ', CAST(turn AS INTEGER)) || CASE WHEN turn > 0 THEN '- ' ELSE '* ' END || '[' || ts || '] ' || subject || '  (' || sender || ')' AS line FROM exports""")
def reply_order(spark, sf_dir):
    walked = forest.forest(exports(spark, sf_dir, FULL))
    lines = forest.forest_lines(walked)
    return walked.select("conv_id", "turn", "root_place", "place").join(lines, ["root_place", "place"])


@query("verify_with_losses", _with(exports_sql(), """
ids AS (SELECT conv_id, turn, any_value(k) AS k, bool_or(name LIKE '%early%' OR name LIKE '%open%') AS kept FROM exports GROUP BY ALL),
held AS (SELECT DISTINCT k FROM exports WHERE name LIKE '%early%' OR name LIKE '%open%'),
n AS (SELECT (SELECT count(DISTINCT name) FROM exports) AS f, (SELECT count(DISTINCT name) FROM exports WHERE name LIKE '%early%' OR name LIKE '%open%') AS b, count(*) AS u,
      count(*) FILTER (WHERE NOT kept AND k NOT IN (SELECT k FROM held)) AS l, count(*) FILTER (WHERE NOT kept AND k IN (SELECT k FROM held)) AS c FROM ids)""") + """
SELECT f AS files_total, b AS branches_kept, u AS unique_messages, l AS n_lost, c AS collapsed, l = 0 AS ok,
       'Collapsed ' || f || ' files -> ' || b || ' branches; ' || u || ' unique messages, ' || l || ' lost.' || CASE WHEN c > 0 THEN ' (' || c || ' cross-format duplicate' || CASE WHEN c = 1 THEN '' ELSE 's' END || ' collapsed)' ELSE '' END AS line FROM n""")
def verify_with_losses(spark, sf_dir):
    """A verdict that keeps too little: only the first turns."""
    return forest.verify_no_loss(exports(spark, sf_dir), _keeps_too_little(spark, sf_dir))


def _keeps_too_little(spark, sf_dir):
    return exports(spark, sf_dir).select("file_id", "name").distinct().withColumn("redundant", ~F.col("name").rlike("early|open"))


@query("lost_messages", _with(exports_sql(), "held AS (SELECT DISTINCT k FROM exports WHERE name LIKE '%early%' OR name LIKE '%open%')") + """
SELECT 'mid:' || conv_id || '-' || turn || '@x' AS node, any_value(sender || ': ' || subject) AS said FROM exports WHERE k NOT IN (SELECT k FROM held)
GROUP BY conv_id, turn HAVING NOT bool_or(name LIKE '%early%' OR name LIKE '%open%')""")
def lost_messages(spark, sf_dir):
    return forest.lost(exports(spark, sf_dir), _keeps_too_little(spark, sf_dir))


# --- timelines -------------------------------------------------------------------------------------------------------


@query("resolved_categories", _with(EVENTS_SQL, "known AS (SELECT DISTINCT category AS c FROM tl WHERE category < 'm')") + """
SELECT pos, CASE WHEN c IS NOT NULL THEN c ELSE '__default__' END AS category, CASE WHEN c IS NOT NULL THEN upper(left(c, 1)) || substr(c, 2) ELSE 'Other' END AS category_label
FROM (SELECT pos, CASE pos % 3 WHEN 0 THEN category WHEN 1 THEN 'group' ELSE 'unknown' END AS wanted FROM tl) LEFT JOIN (SELECT c FROM known UNION ALL SELECT 'group') ON c = wanted""")
def resolved_categories(spark, sf_dir):
    """The event's category, else its group's; those that the registry doesn't know are the default."""
    e, k = timeline_events(spark, sf_dir), F.col("pos") % 3
    rows = e.withColumn("category", F.when(k == 0, F.col("category")).when(k == 2, F.lit("unknown"))).withColumn("group_category", F.lit("group")).drop("category_label")
    names = e.where("category < 'm'").select(F.col("category").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("group").alias("id")))
    registry = names.select("id", X.prettify(F.col("id")).alias("label"), F.lit(None).cast("string").alias("color"))
    return timeline.resolve_categories(rows, registry).select("pos", "category", "category_label")


@query("view_statistics", _with(EVENTS_SQL, """
v AS (SELECT * FROM tl WHERE importance >= 2 AND pos % 5 = 0),
c AS (SELECT tab, category, count(*) AS n, min(pos) AS p FROM v GROUP BY ALL),
b AS (SELECT tab, string_agg(category || ' (' || n || ')', ', ' ORDER BY n DESC, p) AS parts, count(*) AS nc FROM c GROUP BY tab),
k AS (SELECT tab, count(*) AS n, min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi, list(title ORDER BY date, pos) AS titles FROM v GROUP BY tab),
t AS (SELECT tab, count(*) AS total FROM tl GROUP BY tab),
s AS (SELECT *, strftime(lo, '%b ') || day(lo) || strftime(lo, ', %Y') || ' – ' || strftime(hi, '%b ') || day(hi) || strftime(hi, ', %Y') AS span FROM t JOIN k USING (tab) JOIN b USING (tab))""") + """
SELECT tab, n, total, span, nc AS n_categories, n AS n_key, 'Filtered to key events: showing ' || n || ' of ' || total || ' events, ' || span || '. Breakdown: ' || parts || '. Key milestones: '
  || array_to_string(list_transform(titles[1:6], lambda x: '“' || x || '”'), '; ') || CASE WHEN n > 6 THEN ', +' || (n - 6) || ' more' ELSE '' END || '.' AS text FROM s""")
def view_statistics(spark, sf_dir):
    e = timeline_events(spark, sf_dir)
    return timeline.view_overview(e, timeline.filtered(e.where("pos % 5 = 0"), key_only=True), "key events")


@query("tab_flags", _with(exports_sql()) + " SELECT 'f' || (conv_id % 6) AS tab, count(DISTINCT conv_id % 40) AS n_groups, count(DISTINCT conv_id % 40) <= 8 AS legend FROM exports GROUP BY 1")
def tab_flags(spark, sf_dir):
    rows = exports(spark, sf_dir).withColumn("tab", F.concat(F.lit("f"), F.col("conv_id") % 6))
    events = timeline.message_events(unique.unique_messages(rows, ("tab",)).withColumn("path", F.col("name")), tab_col="tab")
    return timeline.tab_flags(timeline.conversations(events))


@query("conversation_tabs", _with(exports_sql()) + """
SELECT 'f' || (conv_id % 6) AS tab, 'F' || (conv_id % 6) AS label, count(DISTINCT conv_id % 40) || ' conversation(s), ' || count(DISTINCT k) || ' message(s) after dedup.' AS description, count(DISTINCT conv_id % 40) <= 8 AS category_filter FROM exports GROUP BY conv_id % 6""")
def conversation_tabs(spark, sf_dir):
    rows = exports(spark, sf_dir).withColumn("tab", F.concat(F.lit("f"), F.col("conv_id") % 6))
    events = timeline.message_events(unique.unique_messages(rows, ("tab",)).withColumn("path", F.col("name")), tab_col="tab")
    return timeline.conversation_tabs(events).select("tab", "label", "description", "category_filter")


@query("tab_labels", "SELECT folder, row_number() OVER (ORDER BY folder) || '. Part ' || right(folder, 1) AS label, 'Part ' || right(folder, 1) AS heading FROM (SELECT DISTINCT '0' || (conv_id % 7) || '_part-' || (conv_id % 7) AS folder FROM conversations)")
def tab_labels(spark, sf_dir):
    k = (F.col("conv_id") % 7).cast("string")
    return timeline.tab_labels(read(spark, sf_dir, "conversations").select(F.concat(F.lit("0"), k, F.lit("_part-"), k).alias("folder")))


@query("bare_groups", "SELECT coalesce(nullif(event_type, 'click'), 'Events') AS group_label, lower(regexp_replace(coalesce(nullif(event_type, 'click'), 'Events'), '[^A-Za-z0-9]+', '-', 'g')) AS group_id, count(*) AS n FROM events GROUP BY 1, 2")
def bare_groups(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("click")).alias("group"), F.col("event_id").alias("pos"))
    return timeline.flatten_array(e).groupBy("group_label", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query("flat_document", _with(EVENTS_SQL, "g AS (SELECT tab, group_id, min(pos) AS p FROM tl GROUP BY ALL)") + """
SELECT 't' AS tab, row_number() OVER (ORDER BY group_id, tl.pos) - 1 AS pos, group_id, title FROM tl""")
def flat_document(spark, sf_dir):
    """A document of one tab and a group for each of the events table's, taken apart again."""
    e = timeline_events(spark, sf_dir).select("group_id", "pos", "title", "date")
    groups = e.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title", "date"))), lambda x: F.struct(x["title"].alias("title"), x["date"].alias("date"))).alias("events"))
    groups = groups.agg(F.array_sort(F.collect_list(F.struct(F.col("group_id").alias("id"), F.col("group_id").alias("label"), F.lit(None).cast("string").alias("category"), "events"))).alias("groups"))
    document = groups.select(F.array(F.struct(F.lit("t").alias("id"), "groups")).alias("tabs"))
    return timeline.flatten_document(document).select("tab", "pos", "group_id", "title")


@query("reading_order", _with(EVENTS_SQL) + " SELECT tab, pos, row_number() OVER (PARTITION BY tab ORDER BY CASE WHEN pos % 9 = 0 THEN 1 ELSE 0 END, CASE WHEN pos % 9 = 0 THEN NULL ELSE date END, pos) AS place FROM tl")
def reading_order(spark, sf_dir):
    """Events with their place in a tab's reading order; every ninth has no date that can be read."""
    e = timeline_events(spark, sf_dir).withColumn("date", F.when(F.col("pos") % 9 == 0, F.lit("soon")).otherwise(F.col("date")))
    return timeline.reading_places(e).select("tab", "pos", "place")


@query("classifier_inputs", _with(exports_sql(), _UNIQUE_SQL) + r"""
SELECT 'e' || (pos + 1) AS id, left(ts, 10) AS date, sender AS "from", subject AS title, CASE WHEN length(flat) <= 160 THEN flat ELSE rtrim(left(flat, 159)) || '…' END AS snippet FROM (SELECT *, trim(regexp_replace(body, '\s+', ' ', 'g')) AS flat FROM placed)""")
def classifier_inputs(spark, sf_dir):
    return organize.classifier_inputs(unique.unique_messages(exports(spark, sf_dir))).select("id", "date", "from", "title", "snippet")


# --- store -----------------------------------------------------------------------------------------------------------


@query("store_sources", _with(exports_sql(), "o AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM exports)") + """
SELECT md5(k) AS k, arg_min('<' || conv_id || '-' || turn || '@x>', struct_pack(a := batch, b := file_id, c := turn)) AS message_id, arg_min(name, struct_pack(a := batch, b := file_id)) AS path,
       CAST(count(*) + count(*) FILTER (WHERE batch = 1) AS BIGINT) AS occurrences FROM o GROUP BY k""")
def store_sources(spark, sf_dir):
    t, _ = _stored(spark, sf_dir)
    k = F.md5(F.concat("sender", F.lit("\x01"), X.fingerprint(F.col("body"))))
    return store.stored_messages(t).select(k.alias("k"), "message_id", "path", "occurrences")


@query("store_purge", _with(exports_sql()) + " SELECT count(DISTINCT k) AS messages FROM exports WHERE conv_id % 2 = 1")
def store_purge(spark, sf_dir):
    """What stays of the messages when only the files of odd conversations are left."""
    t, _ = _stored(spark, sf_dir)
    odd = t.files.where("cast(regexp_extract(name, 'conv_([0-9]+)', 1) as int) % 2 = 1")
    left = store.Tables(odd, t.messages, t.file_messages.join(odd, "file_id", "left_semi"), t.file_attachments)
    return store.purge(left).messages.agg(F.count(F.lit(1)).alias("messages"))


@query("uncovered_files", _with(exports_sql(), PAIRS_SQL) + " SELECT count(*) AS kept, (SELECT count(DISTINCT k) FROM exports) AS keys FROM states WHERE NOT redundant")
def uncovered_files(spark, sf_dir):
    """The kept files and the keys that they hold together: all."""
    k, files = _keys(exports(spark, sf_dir))
    kept = contain.keep(contain.redundancy(k, files))
    held = k.join(kept.select("file_id"), "file_id", "left_semi").select("key").distinct().agg(F.count(F.lit(1)).alias("keys"))
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(held)  # one row each


# --- rules over the given tables' texts --------------------------------------------------------------------------------

#: Words of each text, as both sides cut them.
_WORDS_SQL = "w AS (SELECT doc_id, n_chars, text, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS w FROM documents)"


def _words(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "n_chars", "text", F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)).alias("w"))


def _word(k: int):
    return F.coalesce(F.get("w", F.lit(k - 1)), F.lit(""))


@query("lists_of_words", _with(_WORDS_SQL) + """
SELECT doc_id, array_to_string(w[1:6], '|') AS attachments, CASE WHEN n_chars % 2 = 0 THEN '<' || array_to_string(w[1:3], '>|<') || '>' ELSE array_to_string(w[1:3], '|') END AS refs, lower(w[1]) AS ref FROM w WHERE len(w) > 0""")
def lists_of_words(spark, sf_dir):
    """Header lists of each text's first words, under all separators and with empty entries."""
    d = _words(spark, sf_dir).where(F.size("w") > 0)
    first = F.slice("w", 1, 6)
    listed = F.array_join(F.transform(first, lambda x, k: F.concat(F.lit(" "), x, F.when(k % 3 == 0, F.lit(" ;")).when(k % 3 == 1, F.lit("\t,,")).otherwise(F.lit(";, ")))), "")
    few = F.slice("w", 1, 3)
    refs = F.when(F.col("n_chars") % 2 == 0, F.array_join(F.transform(few, lambda x: F.concat(F.lit("x <"), x, F.lit(">"))), " ")).otherwise(F.array_join(few, " \t"))
    return d.select("doc_id", F.array_join(X.split_attachments(listed), "|").alias("attachments"), F.array_join(X.split_references(refs), "|").alias("refs"), X.message_ref(F.concat(F.lit(" <"), _word(1), F.lit("> "))).alias("ref"))


@query("folders_of_words", _with(_WORDS_SQL, "f AS (SELECT doc_id, n_chars, list_transform(w[1:3], lambda x: replace(upper(left(x, 1)), 'ẞ', 'Ss') || lower(substr(x, 2))) AS t, regexp_replace(lower(array_to_string(w[1:3], '-')), '[^a-z0-9]+', '-', 'g') AS s FROM w WHERE len(w) > 0)") + """
SELECT doc_id, array_to_string(t, ' ') AS tab_label, n_chars || ' ' || array_to_string(t, ' ') AS pretty, n_chars || CASE WHEN trim(s, '-') = '' THEN '' ELSE '-' || trim(s, '-') END AS slug FROM f""")
def folders_of_words(spark, sf_dir):
    d = _words(spark, sf_dir).where(F.size("w") > 0)
    folder = F.concat(F.col("n_chars").cast("string"), F.lit("_-"), F.array_join(F.slice("w", 1, 3), "-_"))
    return d.select("doc_id", X.tab_label(folder).alias("tab_label"), X.prettify(folder).alias("pretty"), X.slug(folder).alias("slug"))


@query("safe_texts", _with(_WORDS_SQL, r"""
v AS (SELECT doc_id, text, md5(text) AS h, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, CAST(n_chars % 10 AS INTEGER) AS n, regexp_replace(text, '[\r\n]+', ' ', 'g') AS flat FROM w)""") + r"""
SELECT doc_id, CASE WHEN n BETWEEN 3 AND 8 THEN '#' || left(h, n) END AS color, CASE WHEN regexp_full_match(a, '[A-Za-z]+') THEN a END AS named_color,
       CASE n % 4 WHEN 0 THEN 'https://' || a || '/' || b WHEN 1 THEN '/' || a END AS href,
       CASE WHEN n IN (3, 6, 7, 8, 9) THEN 'rgba(' || array_to_string(list_transform([1, 2, 3], lambda k: CAST(('0x' || CASE WHEN n = 3 THEN repeat(substr(h, k, 1), 2) ELSE substr(h, 2 * k - 1, 2) END) AS INTEGER)), ',') || ',0.5)' ELSE 'rgba(107,114,128,0.5)' END AS tint,
       coalesce(nullif(trim(regexp_replace(list_extract(string_split(replace(left(flat, 40), '\', '/'), '/'), -1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'upload') AS name,
       '/base/' || a || '/' || b || '.txt' AS link, 'file:///top/' || a || '/' || b || '.txt' AS local FROM v""")
def safe_texts(spark, sf_dir):
    """Colours, links and names made of each text and its digest."""
    d = _words(spark, sf_dir).withColumn("h", F.md5("text")).withColumn("n", (F.col("n_chars") % 10).cast("int"))
    color = F.concat(F.lit(" #"), F.substr("h", F.lit(1), F.col("n")))
    start = F.when(F.col("n") % 4 == 0, F.lit("https://")).when(F.col("n") % 4 == 1, F.lit("/")).when(F.col("n") % 4 == 2, F.lit(" JavaScript\t:")).otherwise(F.lit("data:"))
    href = F.concat(start, _word(1), F.when(F.col("n") % 4 == 0, F.concat(F.lit("/"), _word(2))).otherwise(F.lit("")))
    path = F.concat(F.lit("file:/top/"), _word(1), F.lit("/"), _word(2), F.lit(".txt"))
    flat = F.substring(F.regexp_replace("text", "[\r\n]+", " "), 1, 40)
    return d.select(
        "doc_id", X.safe_color(color).alias("color"), X.safe_color(F.nullif(_word(1), F.lit(""))).alias("named_color"), X.safe_href(href).alias("href"), X.tint(F.concat(F.lit("#"), F.substr("h", F.lit(1), F.col("n"))), "0.5").alias("tint"),
        X.safe_name(flat).alias("name"), X.href_for(path, "/top", "/base").alias("link"), X.href_for(path, "/elsewhere").alias("local"),
    )


@query("dates_of_events", """
SELECT event_id, CASE event_id % 6 WHEN 5 THEN '9999-12-31 23:59:59.999999' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS sent,
       CASE event_id % 6 WHEN 4 THEN strftime(date_trunc('month', ts), '%b %-d') WHEN 5 THEN strftime(ts, '%A') WHEN 3 THEN strftime(date_trunc('year', ts), '%b %-d') ELSE strftime(ts, '%b %-d') END AS short,
       CASE event_id % 6 WHEN 5 THEN '' ELSE strftime(ts, '%Y') END AS year, CASE WHEN event_id % 6 < 5 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%A') END AS iso FROM events""")
def dates_of_events(spark, sf_dir):
    """Every event's time in all the forms that are read, and one that isn't."""
    e = read(spark, sf_dir, "events")
    form = lambda f: F.date_format("ts", f)
    kind = F.col("event_id") % 6
    said = F.when(kind == 0, form("yyyy-M-d H:mm")).when(kind == 1, F.concat(F.lit(" "), form("yyyy/M/d"), F.lit("\t"), form("HH:m"))).when(kind == 2, form("yyyy-MM-dd HH:mm:ss")).when(kind == 3, F.concat(form("yyyy-MM-dd HH:mm"), F.lit(" -0800")))
    said = said.when(kind == 4, F.concat(F.lit("sent on "), form("yyyy/MM/dd"), F.lit(", late"))).otherwise(form("EEEE"))
    short = X.short_date(F.when(kind == 0, form("yyyy-M-d")).when(kind == 1, form(" yyyy/M/d ")).when(kind == 2, form("yyyy-MM-dd")).when(kind == 3, form("yyyy")).when(kind == 4, form("yyyy-MM")).otherwise(form("EEEE")))
    iso = X.iso_date(F.when(kind < 3, form("yyyy/MM/dd HH:mm")).otherwise(said))
    return e.select("event_id", X.sent_at(said).cast("string").alias("sent"), short[0].alias("short"), short[1].alias("year"), iso.alias("iso"))


@query("decoded_texts", "SELECT doc_id, text FROM documents")
def decoded_texts(spark, sf_dir):
    """Every text as UTF-8, with a mark in front, or in an older encoding where it can be said in that, reads as it was."""
    d = read(spark, sf_dir, "documents")
    old = (F.col("doc_id") % 3 == 2) & ~F.col("text").rlike("[^\\x00-\\x7F\\xA0-\\xFF]") & ~F.is_valid_utf8(F.encode("text", "iso-8859-1").cast("string"))
    utf8 = F.col("text").cast("binary")
    content = F.when(old, F.encode("text", "iso-8859-1")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    return d.withColumn("content", content).select("doc_id", sources.decoded(F.col("content")).alias("text"))


@query("mail_bodies", r"""
SELECT conv_id, turn, role || ' of ' || conv_id || ' <' || role || '@x.example>' AS sender, strftime(TIMESTAMP '2025-01-01 08:00' + to_minutes(CAST(conv_id * 60 + turn * 7 AS BIGINT)), '%Y-%m-%d %H:%M') AS timestamp, text || '.txt' AS attachments,
       trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS body FROM (SELECT * REPLACE (trim(regexp_replace(left(text, 80), '[^A-Za-z0-9 ]', '', 'g')) AS text) FROM conversations)""")
def mail_bodies(spark, sf_dir):
    """Each turn as a mail: its words in a table of HTML beside a file that is named after them."""
    c = read(spark, sf_dir, "conversations")
    plain = F.trim(F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z0-9 ]", ""))
    stamp = F.timestamp_seconds(F.lit(1735718400) + (F.col("conv_id") * 60 + F.col("turn") * 7) * 60)
    said = F.concat(
        F.lit("From: =?utf-8?b?"), F.base64(F.concat("role", F.lit(" of "), F.col("conv_id").cast("string")).cast("binary")), F.lit("?= <"), "role", F.lit("@x.example>\nDate: "), F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0530\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n"),
        F.lit("--b\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.concat(F.lit("<table><tr><td>"), F.replace(plain, F.lit(" "), F.lit("</td>\t<td>")), F.lit("</td></tr></table>")).cast("binary")),
        F.lit("\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename*=utf-8''"), F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20")), F.lit(".txt\n\nx\n--b--\n"),
    )
    files = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("file_id"), F.lit("x.eml").alias("name"), said.cast("binary").alias("content"), F.lit("eml").alias("kind"))
    return mail.parse_mail(files).select(F.expr("file_id div 100").alias("conv_id"), (F.col("file_id") % 100).alias("turn"), "sender", "timestamp", F.array_join("attachments", "|").alias("attachments"), "body")


_FAULTS = ["fine", "cut", "silent", "no_json", "shape"]


@query("classifier_answers", f"""
WITH a AS (SELECT conv_id, {_chosen(_FAULTS, 'conv_id')} AS kind, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, nullif(kind, 'fine') AS problem, CASE WHEN kind IN ('fine', 'cut') THEN 'Talk ' || conv_id END AS title, CASE WHEN kind IN ('fine', 'cut') THEN n END AS assigned FROM a""")
def classifier_answers(spark, sf_dir):
    """A service's response for each conversation, whole or broken in each of the ways that are told apart."""
    c = read(spark, sf_dir, "conversations")
    given = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("category"), (F.col("turn") % 4).cast("int").alias("importance"), F.col("text").alias("summary"))
    rows = c.groupBy("conv_id").agg(F.collect_list(given).alias("assignments"), F.collect_set(F.struct(F.col("role").alias("id"), F.upper("role").alias("label"))).alias("categories"))
    kind = _pick(_FAULTS, F.col("conv_id"))
    answer = F.to_json(F.struct(F.concat(F.lit("Talk "), F.col("conv_id")).alias("title"), "categories", F.when(kind != "shape", F.col("assignments")).alias("assignments")))
    said = F.when(kind == "silent", F.lit("")).when(kind == "no_json", F.concat(F.lit("Sure! "), answer)).when(kind == "shape", F.concat(F.lit("["), answer, F.lit("]"))).otherwise(answer)
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")), F.struct(F.lit("text").alias("type"), said.alias("text")))
    body = F.to_json(F.struct(F.when(kind == "cut", F.lit(organize.CUT_OFF)).otherwise(F.lit("end_turn")).alias("stop_reason"), blocks.alias("content")))
    out = organize.decoded(rows.select(F.col("conv_id").alias("batch"), body.alias("body")))
    usable = F.coalesce("problem", F.lit("cut")) == "cut"
    return out.select(F.col("batch").alias("conv_id"), "problem", F.when(usable, F.col("title")).alias("title"), F.when(usable, F.size("assignments").cast("long")).alias("assigned"))


@F.pandas_udf(T.BinaryType())
def _with_fonts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pdf.font_pdf(t.split("\n")))


@query("pdf_fonts", r"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^ -~À-ÿ\n]', '', 'g'), '[ \n]*\n[ \n]*', chr(10), 'g'), chr(10) || ' '), chr(10)), lambda x: x <> ''), chr(10)) AS text FROM documents WHERE length(trim(regexp_replace(text, '[^ -~À-ÿ]', '', 'g'))) >= 200")
def pdf_fonts(spark, sf_dir):
    """Every longer text as a PDF of compressed objects whose font numbers its letters anew, read back."""
    d = read(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", "[^ -~À-ÿ\n]", "")
    lines = F.trim(F.regexp_replace(plain, "[ \n]*\n[ \n]*", "\n"))
    d = d.where(F.length(F.trim(F.regexp_replace("text", "[^ -~À-ÿ]", ""))) >= 200)
    files = d.select(F.col("doc_id").alias("file_id"), F.lit("x.pdf").alias("name"), _with_fonts(lines).alias("content"))
    return pdf.read_pdf(files).select(F.col("file_id").alias("doc_id"), "text")
