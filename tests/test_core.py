"""The archive operators on corpora of our own, against stated results, plain Python models and their invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import contain, forest, organize, store, timeline, unique
from strandline.operators.keys import file_keys
from strandline.plans import catalog, render
from strandline.schema import MESSAGE, MESSAGE_FIELDS
from strandline.sources import files as sources
from strandline.sources import mail, pdf, text_exports


def message(file_id, name, idx, sender="", body="", sent="", subject="", mid="", reply="", refs=(), attachments=(), to=""):
    return (file_id, name, idx, sender, sent, to, subject, list(attachments), body, mid, reply, list(refs))


def evaluate(spark, values, *columns):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", *columns).orderBy("k").collect()


def test_lexical_rules_follow_python(spark):
    r = random.Random(1)
    pieces = ["a", "B c", "\n", "\r\n", "\x0b", "\x85", " ", " ", "\t", "> q", "-- ", "--", "On Monday", "x wrote:", "-----Original Message-----", "\xa0", "É"]
    values = ["", "\n", "a\n", "a\n\n", X.SPACES, X.SPACES + "é 漢" + X.SPACES, "\u200bx\u200b", *("".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(300))]

    def clean(body):
        lines = body.splitlines()
        cut = next((i for i, x in enumerate(lines) if re.match(r"^\s*-{2,}\s*(original message|forwarded message)\s*-{2,}\s*$", x, re.I)), len(lines))
        for i, x in enumerate(lines):
            if re.match(r"On\b", x.strip(), re.I) and "wrote:" in " ".join(y.strip() for y in lines[i : i + 3]).lower():
                cut = min(cut, i)
                break
        body = "\n".join(x for x in lines[:cut] if not x.lstrip().startswith(">")).strip()
        lines = body.splitlines()
        sign = next((i for i, x in enumerate(lines) if re.match(r"^--[ \t]?$", x)), None)
        return body if sign is None else "\n".join(lines[:sign]).strip()

    c = F.col("v")
    for v, row in zip(values, evaluate(spark, values, X.split_lines(c).alias("lines"), X.strip(c).alias("strip"), X.fingerprint(c).alias("fp")), strict=True):
        assert row.lines == v.splitlines() and row.strip == v.strip()
        assert row.fp == " ".join(clean(v).split()).lower(), repr(v)


def test_names_dates_and_links(spark):
    values = ["Ann Lee <Ann@X.example>", "bob@y.example", "", "RE: fwd : Hello World", "2025-03-04 9:05", "2025/03/04 10:00 -0800", "01_first-part", "javascript:alert(1)", "#1e88e5", "red;}", "../a b?.txt", "2025-02-31", "2025-03-04\t09:05"]
    c = F.col("v")
    rows = evaluate(spark, values, X.normal_sender(c).alias("s"), X.display_name(c).alias("d"), X.base_subject(c).alias("b"), X.slug(c).alias("slug"), X.sent_at(c).cast("string").alias("at"), X.iso_date(c).alias("iso"), X.tab_label(c).alias("tab"), X.safe_href(c).alias("href"), X.safe_color(c).alias("color"), X.safe_name(c).alias("name"))
    assert rows[0].s == "ann@x.example" and rows[0].d == "Ann Lee" and rows[1].d == "bob@y.example" and rows[2].d == "Unknown" and rows[2].slug == "x"
    assert rows[3].b == "Hello World" and rows[4].at == "2025-03-04 09:05:00" and rows[5].at == "2025-03-04 00:00:00" and rows[12].at == "2025-03-04 09:05:00"
    assert rows[6].tab == "First Part" and rows[7].href is None and rows[8].color == "#1e88e5" and rows[9].color is None and rows[10].name == "a_b_.txt"
    assert rows[11].at.startswith("9999") and rows[11].iso == "2025-02-31"


def test_dates_follow_strptime(spark):
    from datetime import datetime

    def sent(v):
        v = v.strip()
        for form in ("%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y-%m-%d"):
            try:
                return datetime.strptime(v, form)
            except ValueError:
                pass
        m = re.search(r"(\d{4})[-/](\d{2})[-/](\d{2})", v)
        try:
            return datetime(*map(int, m.groups())) if m else None
        except ValueError:
            return None

    def day(v):
        for form in ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%Y"):
            try:
                return datetime.strptime(v.strip(), form).date()
            except ValueError:
                pass
        return None

    r = random.Random(3)
    values = ["", "2025", "2025-13", "2025/03", "0000-01-01", "2025-02-29", "2024-02-29 24:00", "2025-1-2 3:4:59", "2025-1-2 3:4:60", "2025/1/2 3:4:5", "2025-03-04T10:00", "x 2025-03-04 10:00", "2025-03/04", " 2025-03-04\t9:05 "]
    for _ in range(500):
        sep = r.choice("-/")
        v = f"{r.choice([1999, 2025])}{sep}{r.randint(0, 13):0{r.choice([1, 2])}d}{sep}{r.randint(0, 32):0{r.choice([1, 2])}d}"
        values.append(v + r.choice(["", f" {r.randint(0, 25)}:{r.randint(0, 61):02d}", f"  {r.randint(0, 24)}:{r.randint(0, 60)}:{r.randint(0, 59)}", " -0800", "T1"]))
    for v, row in zip(values, evaluate(spark, values, X.sent_at(F.col("v")).alias("at"), X.event_date(F.col("v")).alias("day")), strict=True):
        at = None if row.at is None or row.at.year == 9999 else row.at
        assert at == sent(v), (v, at, sent(v))
        assert row.day == day(v), (v, row.day, day(v))


CORPUS = {
    "all.txt": "abcd", "same_as_all.txt": "abcd", "start.txt": "ab", "fork.txt": "abe", "one.txt": "a", "empty.txt": "",
}


def frames(spark, corpus):
    rows = [message(k, n, i, "s", body) for k, (n, bodies) in enumerate(corpus) for i, body in enumerate(bodies)]
    files = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(corpus)], "file_id long, name string")
    return spark.createDataFrame(rows, MESSAGE), files


def test_verdict_of_a_small_corpus(spark):
    messages, files = frames(spark, list(CORPUS.items()))
    out = {r.name: r for r in contain.verdict(file_keys(messages), files).collect()}
    assert {n for n, r in out.items() if not r.redundant} == {"all.txt", "fork.txt"}
    assert out["start.txt"].superseded_by == ["all.txt", "fork.txt", "same_as_all.txt"] and out["start.txt"].covered_by == ["all.txt", "fork.txt"]
    assert out["same_as_all.txt"].superseded_by == ["all.txt"] and out["empty.txt"].n_keys == 0 and out["empty.txt"].redundant


def test_verdict_against_the_rule(spark):
    r = random.Random(7)
    corpus = [(f"f{r.randint(0, 30):02d}", "".join(sorted(set(r.choice("abcdef") for _ in range(r.randint(0, 4)))))) for _ in range(40)]
    messages, files = frames(spark, corpus)
    keys = file_keys(messages)
    out = {r.file_id: r for r in contain.verdict(keys, files).collect()}
    for k, (name, own) in enumerate(corpus):
        expected = sorted(n for n, other in corpus if n != name and (set(own) < set(other) or set(own) == set(other) and n < name))
        assert out[k].superseded_by == expected and out[k].redundant == bool(expected)
    assert contain.uncovered(keys, contain.redundancy(keys, files)).count() == 0


TEXT = "ignored\n\nFrom: Ann <ann@x>\nSent: 2025-01-02 10:00\nTo: bob\nSubject: A long\n subject\nAttachments: a.pdf; b.PDF,\nReferences: <1@x> <2@x>\n\nHello\n\nFrom here on it is body? no\nFrom: not after a blank\n\nFrom: Bob\nDate: 2025-01-01\nplain body at once\n"


def test_text_export(spark):
    out = text_exports.parse_exports(spark.createDataFrame([(1, "t.txt", TEXT), (2, "e.txt", ""), (3, "n.txt", None), (4, "x.txt", "To: me\n\nbody")], "file_id long, name string, text string")).orderBy("msg_idx").collect()
    assert [r.sender for r in out] == ["Ann <ann@x>", "Bob"]
    assert out[0].subject == "A long subject" and out[0].attachments == ["a.pdf", "b.PDF"] and out[0].references == ["<1@x>", "<2@x>"] and out[0].body.startswith("Hello\n\nFrom here") and out[0].timestamp == "2025-01-02 10:00"
    assert out[1].timestamp == "2025-01-01" and out[1].body == "plain body at once"
    back = text_exports.parse_exports(text_exports.render_exports(spark.createDataFrame(out, MESSAGE))).orderBy("msg_idx").collect()
    assert [r.body for r in back][1:] == [out[1].body] and [r.sender for r in back] == [r.sender for r in out]


EML = b"From: =?utf-8?q?J=C3=B6rg?= <j@x>\nTo: a@b\nSubject: =?utf-8?b?SMOpbGxv?=\nDate: Mon, 6 Jan 2025 09:30:00 -0800\nMessage-ID: <m1@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>Hi&nbsp;<b>you</b></p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=notes.pdf\n\nx\n--b--\n"


def test_reading_a_directory(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "b.mbox").write_bytes(b"From x Mon\nFrom: x\nSubject: one\n\nfirst\n\nFrom y Tue\nFrom: y\n\nsecond\n")
    (tmp_path / "c.txt").write_bytes("From: z\n\ndash – here".encode("cp1252"))
    (tmp_path / "notes.pdf").write_bytes(pdf.simple_pdf(["an attachment, long enough"]))
    (tmp_path / "saved.pdf").write_bytes(pdf.simple_pdf(["From: q (x)", "", "a page that was saved"], deflate=True))
    (tmp_path / "scan.pdf").write_bytes(b"%PDF nothing to read")
    (tmp_path / "x.csv").write_text("no")
    messages, files = sources.read_messages(spark, str(tmp_path))
    rows = {(r.name, r.msg_idx): r for r in messages.collect()}
    assert sorted(r.name for r in files.collect()) == ["a.eml", "b.mbox", "c.txt", "saved.pdf"]
    first = rows["a.eml", 0]
    assert (first.sender, first.subject, first.timestamp, first.body, first.attachments) == ("Jörg <j@x>", "Héllo", "2025-01-06 09:30", "Hi\xa0 you", ["notes.pdf"])
    assert rows["b.mbox", 1].body == "second" and rows["c.txt", 0].body == "dash – here" and rows["saved.pdf", 0].sender == "q (x)"


def test_mail_and_pdf_parts():
    assert mail.split_mailbox(b"") == [] and len(mail.split_mailbox(b"From a\nx\n\nFrom b\ny\n")) == 2
    assert pdf.pdf_text(pdf.simple_pdf(["a (b) \\ c", "", "next"])) == "a (b) \\ c\n\nnext"
    assert pdf.stream_text(b"BT <48 69> Tj (\\101\\n) ' ET") == "Hi\nA"


def test_uploads(spark):
    good, skipped = sources.uploads(spark, [{"name": "../a.txt", "content": "one"}, {"name": "a.txt", "content": "two"}, {"name": "b.pdf", "content": "eA==", "encoding": "base64"}, {"name": "c.exe", "content": "x"}])
    assert {r.name: bytes(r.content) for r in good.collect()} == {"a.txt": b"two", "b.pdf": b"x"} and [r.name for r in skipped.collect()] == ["c.exe"]


THREAD = [
    message(0, "f", 0, "a", "open", "2025-01-01 09:00", "S", "<1@x>"), message(0, "f", 1, "b", "late", "2025-01-01 10:00", "S", "<2@x>", "<1@x>"), message(0, "f", 2, "c", "early", "2025-01-01 9:30", "S", "<3@x>", "", ["<0@x>", "<1@x>"]),
    message(1, "g", 0, "b", "LATE ", "2025-01-01 11:00", "S"), message(1, "g", 1, "d", "loop", "2025-01-02", "L", "<l1@x>", "<l2@x>"), message(1, "g", 2, "d", "loop two", "2025-01-02", "L", "<l2@x>", "<l1@x>"),
]


def test_forest_and_loss_proof(spark):
    messages = spark.createDataFrame(THREAD, MESSAGE)
    walked = forest.forest(messages).cache()
    assert [(r.body, r.depth) for r in walked.orderBy("root_place", "place").collect()] == [("open", 0), ("early", 1), ("late", 1), ("LATE ", 0)]
    assert forest.stranded(messages, walked).count() == 2
    assert [r.line for r in forest.forest_lines(walked).orderBy("root_place", "place").collect()][1] == "  - [2025-01-01 9:30] S  (c)"
    files = spark.createDataFrame([(0, "f"), (1, "g")], "file_id long, name string")
    kept = forest.verify_no_loss(messages, files.withColumn("redundant", F.col("file_id") == 1)).first()
    assert (kept.n_lost, kept.collapsed, kept.ok) == (2, 1, False) and kept.line.endswith("(1 cross-format duplicate collapsed)")


def test_unique_and_store(spark, tmp_path):
    one = spark.createDataFrame([message(0, "a", 0, "s", "hello", "2025-01-02"), message(0, "a", 1, "s", "more", "2025-01-03", attachments=["X.pdf"])], MESSAGE)
    two = spark.createDataFrame([message(0, "b", 0, "S ", " HELLO", "2025-01-01", mid="<1@x>"), message(0, "b", 1, "t", "hello", "")], MESSAGE)
    both = one.unionByName(two.withColumn("file_id", F.lit(1).cast("long")))
    assert sorted((r.sender, r.name, r.occurrences) for r in unique.unique_messages(both).collect()) == [("S ", "b", 2), ("s", "a", 1), ("t", "b", 1)]
    assert unique.duplicate_counts(both).first().asDict() == {"total": 4, "unique_messages": 3, "duplicates": 1}
    s = store.Store(spark, str(tmp_path / "store"))
    paths = lambda n: spark.createDataFrame([(0, f"/{n}", n)], "file_id long, path string, name string")
    assert s.add(one, paths("a"), "t1") == {"added": 1, "refreshed": 0, "messages_added": 2, "messages_seen": 0}
    assert s.add(two, paths("b"), "t2") == {"added": 1, "refreshed": 0, "messages_added": 1, "messages_seen": 1}
    assert s.add(one, paths("a"), "t3") == {"added": 0, "refreshed": 1, "messages_added": 0, "messages_seen": 2}
    t = s.read()
    assert store.stats(t).first().asDict() == {"files": 2, "messages": 3, "attachments": 1}
    hello = [r for r in store.stored_messages(t).collect() if r.sender == "S "][0]
    assert (hello.timestamp, hello.message_id, hello.first_seen, hello.path) == ("2025-01-01", "<1@x>", "t1", "/a")
    assert {r.name: r.redundant for r in store.store_verdict(t).collect()} == {"a": False, "b": False}


def test_classifier(spark):
    rows = spark.createDataFrame([message(0, "a", k, "s", f"body {k}", f"2025-01-0{k + 1}", f"T{k}") for k in range(4)], MESSAGE)
    inputs = organize.classifier_inputs(unique.unique_messages(rows)).cache()
    with pytest.raises(organize.ClassifierError):
        organize.classify_messages(inputs, None)
    with pytest.raises(organize.ClassifierError):
        organize.classify_messages(inputs, lambda e: {})
    answer = organize.classify_messages(inputs, lambda emails: {"categories": [{"id": "b", "label": "B"}, {"id": "a", "label": "A"}], "assignments": [{"id": e["id"], "category": "ab?"[k % 3], "importance": k} for k, e in enumerate(emails)]})
    out = organize.assemble(inputs, *organize.classification_frames(spark, answer)).orderBy("pos").collect()
    assert [(r.category, r.group_ordinal, r.importance) for r in out] == [("a", 1, 0), ("b", 0, 1), ("uncategorized", 2, 2), ("a", 1, 3)]


def test_page_escapes_and_counts(spark, tmp_path):
    rows = [("t", 0, "g", "<script>", "2025-01-01", "<b>x</b>", "cat", 2), ("t", 1, "g", "<script>", "soon", "second", None, 0)]
    events = spark.createDataFrame(rows, "tab string, pos long, group_id string, group_label string, date string, title string, category string, importance int")
    page, n = render.render_timeline("T & co", events)
    assert n == 2 and "<b>x</b>" not in page and "<h3><script>" not in page and "T &amp; co" in page and page.count("<circle") == 1
    render.write_draft(str(tmp_path / "e.json"), render.draft("T", events))
    title, again, declared = render.load_events(spark, str(tmp_path / "e.json"))
    assert title == "T" and [r.title for r in again.orderBy("pos").collect()] == ["<b>x</b>", "second"]


def test_fields_and_catalogue():
    assert len(MESSAGE_FIELDS) == 12 and set(catalog.SQL) <= set(catalog.QUERIES)
    assert timeline.KEY == 2


def test_command_without_files(spark, tmp_path, capsys):
    from strandline import cli

    (tmp_path / "x.csv").write_text("")
    assert cli.main(["dedup", str(tmp_path)]) == 1
    assert "No message files" in capsys.readouterr().out
