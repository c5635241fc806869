"""The commands, the working set and the local page on real files: a small archive of every format, against stated results."""

import base64
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from strandline import cli, web
from strandline.operators import contain, forest, organize, store, timeline, unique, workspace
from strandline.operators.keys import file_keys
from strandline.plans import render
from strandline.schema import MESSAGE
from strandline.sources import files as sources
from strandline.sources import mail, pdf


def said(sender, day, subject, body, mid="", reply="", attachments=""):
    head = [f"From: {sender}", f"Sent: 2025-03-{day:02d} 10:00", "To: team@x.example", f"Subject: {subject}"]
    head += [f"{k}: {v}" for k, v in (("Attachments", attachments), ("Message-ID", mid), ("In-Reply-To", reply)) if v]
    return "\n".join(head) + f"\n\n{body}\n"


def eml(sender, day, subject, body, mid, reply="", kind="plain"):
    head = f"From: {sender}\nTo: team@x.example\nSubject: {subject}\nDate: Mon, {day} Mar 2025 10:00:00 -0500\nMessage-ID: {mid}\n" + (f"In-Reply-To: {reply}\n" if reply else "")
    return head + f"MIME-Version: 1.0\nContent-Type: text/{kind}; charset=utf-8\n\n{body}\n"


ANN, BOB = "Ann Lee <ann@x.example>", "Bob <bob@x.example>"
A, B, C = "Shall we ship on Friday?", "Yes, the tests are green.", "Shipped. Notes attached."
THREAD = [said(ANN, 3, "Release", A), said(BOB, 4, "RE: Release", B), said(ANN, 5, "RE: Release", C, attachments="notes.pdf")]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    (d / "full.txt").write_text("\n".join(THREAD))
    (d / "early.txt").write_text("\n".join(THREAD[:2]))
    (d / "quoted.eml").write_text(eml(BOB, 4, "RE: Release", f"{B}\n\nOn Mon, Mar 3, 2025 Ann wrote:\n> {A}\n", "<b@x>", "<a@x>"))
    (d / "box.mbox").write_text("".join(f"From x Mon Mar 3\n{m}\n" for m in (eml(ANN, 3, "Release", f"<p>{A}</p>", "<a@x>", kind="html"), eml(BOB, 4, "RE: Release", B, "<b@x>", "<a@x>"), eml(BOB, 6, "Lunch", "Noon?\nFrom here on it is a new record", "<l@x>"))))
    (d / "notes.pdf").write_bytes(pdf.simple_pdf(["Release notes, which Ann attached"]))
    (d / "open.pdf").write_bytes(pdf.simple_pdf(THREAD[0].split("\n"), deflate=True))
    (d / "scan.pdf").write_bytes(b"%PDF-1.4 nothing to read")
    (d / "memo.csv").write_text("no export")
    return d


def test_reading_report(spark, archive):
    found = sources.read_directory(spark, str(archive))
    assert {r.name: r.status for r in found.report.collect()} == {"full.txt": "read", "early.txt": "read", "quoted.eml": "read", "box.mbox": "read", "open.pdf": "read", "scan.pdf": "unreadable", "notes.pdf": "attachment"}
    rows = {(r.name, r.msg_idx): r for r in found.messages.collect()}
    # "From " begins a record wherever it begins a line, as mailbox readers have it.
    assert [rows["box.mbox", k].subject for k in range(4)] == ["Release", "RE: Release", "Lunch", ""] and rows["box.mbox", 0].body == A and ("box.mbox", 4) not in rows
    assert rows["box.mbox", 0].timestamp == "2025-03-03 10:00" and rows["full.txt", 2].attachments == ["notes.pdf"]


def test_mailboxes_in_ranges_are_those_read_whole(spark, tmp_path):
    box = b"preamble\n" + b"".join(b"From a%d\r\nFrom: s%d\r\nSubject: n%d\r\n\r\nbody %d\r\n\r\n" % (k, k, k, k) for k in range(3000))
    (tmp_path / "a b.mbox").write_bytes(box)
    (tmp_path / "two.mbox").write_bytes(b"From q\nSubject: one\n\nx\n")
    (tmp_path / "empty.mbox").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = sources.read_directory(spark, str(tmp_path)).messages.orderBy("name", "msg_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = [mail.fields_of(m) for m in mail.split_mailbox(box)]
    assert [(r.msg_idx, r.subject, r.body) for r in rows if r.name == "a b.mbox"] == [(k, m["subject"], m["body"]) for k, m in enumerate(whole)] and len(whole) == 3000
    assert [(r.name, r.subject) for r in rows][-1] == ("two.mbox", "one") and len(rows) == 3001


def test_dedup(spark, archive, capsys):
    assert cli.main(["dedup", str(archive)]) == 0
    out = capsys.readouterr().out
    assert "KEEP (2)\n  box.mbox\n  full.txt\n" in out and "DELETE (3)" in out and "early.txt  covered by box.mbox, full.txt" in out
    assert "open.pdf  covered by box.mbox, full.txt" in out and "not read: scan.pdf" in out and "no files were deleted" in out
    assert cli.main(["dedup", str(archive), "--pattern", "*.nothing"]) == 1


def test_tree(spark, archive, capsys):
    assert cli.main(["tree", str(archive)]) == 0
    out = capsys.readouterr().out
    assert "0 lost" in out and "* [2025-03-03 10:00] Release  (Ann Lee)\n  - [2025-03-04 10:00] RE: Release  (Bob)" in out


def test_timeline_draft_and_page(spark, archive, tmp_path, capsys):
    page, draft, again = (str(tmp_path / x) for x in ("t.html", "d.json", "again.html"))
    assert cli.main(["timeline-threads", str(archive), "-o", page]) == 0
    text = open(page, encoding="utf-8").read()
    assert text.count("<article") == 5 and f"file://{archive}/full.txt" in text and "duplicates collapsed" in capsys.readouterr().out
    assert cli.main(["ingest", str(archive), "-o", draft]) == 0
    assert [len(g["events"]) for g in json.load(open(draft, encoding="utf-8"))["tabs"][0]["groups"]] in ([3, 1, 1], [3, 1, 1][::-1])
    for source in (draft, page, again):
        assert cli.main(["timeline", source, "-o", again]) == 0
        text = open(again, encoding="utf-8").read()
        assert text.count("<article") == 5 and "<h2>Conversations</h2>" in text
    assert "3 conversation(s), 5 message(s) after dedup." in open(draft, encoding="utf-8").read()


def test_tabs_of_a_document(spark, tmp_path):
    path = tmp_path / "d.json"
    event = {"title": "x", "date": "2025", "category": "c"}
    path.write_text(json.dumps({"title": "T", "subtitle": "sub", "categories": [{"id": "c", "label": "Cat", "color": "#123456"}], "tabs": [{"id": "a", "label": "1. A", "heading": "Own heading", "description": "About", "summary": "Written by hand", "filters": False, "legend": False, "groups": [{"label": "G", "events": [event]}]}, {"id": "b", "groups": [{"label": "G", "events": [event]}]}]}))
    d = render.load_document(spark, str(path))
    page, n = render.render_timeline(d.title, d.events, d.declared, d.subtitle, tabs=d.tabs)
    one, two = page.split('<section class="tab"')[1:]
    assert n == 2 and "<h2>Own heading</h2><p>About</p><p>Written by hand</p>" in one and "<button" not in one and "#123456" in one and '<span class="badge">Cat</span>' in one
    assert "This timeline tracks 1 event" in two and "<button" in two and ">1. A</a>" in page
    again = tmp_path / "p.html"
    again.write_text(page)
    assert [r.asDict() for r in render.load_document(spark, str(again)).tabs.orderBy("tab").collect()][0]["summary"] == "Written by hand"


def test_folders_are_tabs(spark, tmp_path):
    for folder, body in (("02_second-part", A), ("01 first", B)):
        (tmp_path / folder / "deep").mkdir(parents=True)
        (tmp_path / folder / "t.txt").write_text(said(ANN, 3, "S", body))
        (tmp_path / folder / "deep" / "u.txt").write_text(said(ANN, 3, "S", "not counted"))
    (tmp_path / "beside.txt").write_text(said(ANN, 3, "S", C))
    found = sources.read_directory(spark, str(tmp_path), recursive=True)
    rows = found.messages.join(found.files.select("file_id", "path"), "file_id")
    events, labels, numbers = cli.folder_events(rows, found.files, str(tmp_path), "/base")
    assert labels == {"01-first": "1. First", "02-second-part": "2. Second Part"} and numbers == {"folders": 2, "files": 2, "unique": 2, "duplicates": 0}
    assert {(r.tab, r.source.href) for r in events.collect()} == {("01-first", "/base/01 first/t.txt"), ("02-second-part", "/base/02_second-part/t.txt")}


def test_store_command(spark, archive, tmp_path, capsys):
    where = str(tmp_path / "store")
    assert cli.main(["store", "add", where, str(archive)]) == 0 and cli.main(["store", "add", where, str(archive), "--pattern", "*.txt"]) == 0
    assert cli.main(["store", "stats", where]) == 0 and cli.main(["store", "dedup", where]) == 0
    out = capsys.readouterr().out
    assert "{'added': 4, 'refreshed': 0, 'messages_added': 5, 'messages_seen': 5}" in out and "{'added': 0, 'refreshed': 2, 'messages_added': 0, 'messages_seen': 5}" in out
    assert "{'files': 4, 'messages': 5, 'attachments': 1}" in out and "KEEP (2)" in out
    assert cli.main(["store", "timeline", where, "-o", str(tmp_path / "s.html")]) == 0 and "Wrote 5 events" in capsys.readouterr().out


def test_store_merges_its_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    s = store.Store(spark, str(tmp_path / "store"))
    frame = lambda k: spark.createDataFrame([(0, "f", 0, "s", f"2025-01-0{9 - k}", "", "", [" ", "A.pdf ", "a.pdf"], "same", "", "", []), (0, "f", 1, "s", "", "", "", [], f"own {k}", "", "", [])], MESSAGE)
    for k in range(5):
        s.add(frame(k), spark.createDataFrame([(0, f"/{k % 4}", "f")], "file_id long, path string, name string"), f"t{k}")
    t = s.read()
    assert store.stats(t).first().asDict() == {"files": 4, "messages": 6, "attachments": 2} and sorted(p["level"] for p in s.version()["parts"]) == [0, 0, 1]
    same = [r for r in t.messages.collect() if r.body == "same"][0]
    assert (same.timestamp, same.first_seen, same.occurrences) == ("2025-01-05", "t0", 5)
    assert sorted(r.name for r in store.display_names(t).collect()) == ["f", "f#1", "f#2", "f#3"]
    with pytest.raises(store.StoreConflict):
        s._publish(s.version()["number"], None, [])
    assert store.stats(store.purge(t)).first().messages == 5  # own 0 was in /0, which batch 4 took in anew


def test_organize(spark, archive, tmp_path, capsys):
    asked = []

    def transport(request):
        asked.append(request)
        messages = json.loads(request["messages"][0]["content"].split("\n\n", 1)[1])
        answer = {"title": "Sorted", "categories": [{"id": "ship", "label": "Shipping"}, {"id": "rest", "label": "Rest"}], "assignments": [{"id": m["id"], "category": "ship" if "Release" in m["subject"] else "?", "importance": 2, "summary": f"on {m['subject']}"} for m in messages]}
        return {"content": [{"type": "text", "text": json.dumps(answer)}]}

    page, draft = str(tmp_path / "o.html"), str(tmp_path / "o.json")
    assert cli.main(["organize", str(archive), "-o", page, "--draft", draft, "--model", "m"], transport) == 0
    assert asked[0]["model"] == "m" and asked[0]["output_config"]["format"]["type"] == "json_schema"
    document = json.load(open(draft, encoding="utf-8"))
    assert document["title"] == "Sorted" and [(g["label"], len(g["events"])) for g in document["tabs"][0]["groups"]] == [("Shipping", 3), ("Uncategorized", 2)]
    assert "on Release" in open(page, encoding="utf-8").read()
    assert cli.main(["organize", str(archive)]) == 2 and "no classifier" in capsys.readouterr().out
    for broken in ({"stop_reason": "max_tokens"}, {"content": []}, {"content": [{"type": "text", "text": "no"}]}, {"content": [{"type": "text", "text": "[1]"}]}):
        with pytest.raises(organize.ClassifierError):
            organize.parse_response(spark, broken)


def uploads_of(archive):
    out = [{"name": p.name, "content": p.read_text()} for p in sorted(archive.iterdir()) if p.suffix in (".txt", ".eml", ".mbox", ".csv")]
    return out + [{"name": p.name, "encoding": "base64", "content": base64.b64encode(p.read_bytes()).decode()} for p in sorted(archive.glob("*.pdf"))]


def test_working_set(spark, archive):
    w, skipped = workspace.working_set(spark, [*uploads_of(archive), {"name": "x.pdf", "encoding": "base64", "content": "?"}])
    assert {r.name for r in skipped.collect()} == {"memo.csv", "x.pdf"}
    states = workspace.file_states(w.messages, w.inputs).cache()
    assert {r.name: r.redundant for r in states.collect()} == {"box.mbox": False, "full.txt": False, "early.txt": True, "quoted.eml": True, "open.pdf": True}
    assert workspace.summary(w.messages, states).first().asDict() == {"files": 5, "kept": 2, "redundant": 3, "unique_messages": 5, "duplicates": 6}
    chosen = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    events, report = workspace.build(w, chosen("full.txt", "nothing.txt"))
    assert report.first().subtitle == "1 selected file(s); 3 unique message(s) after dedup (0 duplicates collapsed)."
    assert [tuple(a) for r in events.collect() for a in r.attachments] == [("notes.pdf", "/source/notes.pdf")]
    assert workspace.build(w, chosen())[1].first().error == workspace.NOTHING_SELECTED
    a, b = ({r.key_id for r in workspace.file_view(w.messages, n).collect()} for n in ("early.txt", "full.txt"))
    assert a < b and workspace.file_view(w.messages, "../secret").count() == 0
    out = {(r.kind, r.msg_idx): r.only_here for r in workspace.compare(w.messages, "full.txt", "early.txt").collect()}
    assert out == {("message", 0): False, ("message", 1): False, ("message", 2): True, ("attachment", 2): True}


def test_page_over_http(spark, archive):
    at = web.server(spark)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{at.server_address[1]}"
    get = lambda path: urllib.request.urlopen(base + path).read()
    post = lambda path, body: json.loads(urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), method="POST")).read())
    try:
        assert b"<title>strandline" in get("/") and b"Nothing" in get("/timeline")
        state = post("/api/upload", {"files": uploads_of(archive)})
        assert (state["saved"], state["skipped"], state["summary"]["kept"]) == (7, ["memo.csv"], 2)
        assert post("/api/build", {"selected": [f["name"] for f in state["files"] if not f["redundant"]]})["count"] == 5
        assert b"/source/notes.pdf" in get("/timeline") and get("/source/notes.pdf").startswith(b"%PDF")
        assert json.loads(get("/api/file?name=full.txt"))["messages"][2]["attachments"] == ["notes.pdf"]
        assert json.loads(get("/api/file?name=../x"))["ok"] is False and post("/api/build", {"selected": []})["ok"] is False
        with pytest.raises(urllib.error.HTTPError):
            get("/source/missing.txt")
        assert post("/api/load_timeline", {"html": "<p>kept</p>"})["ok"] and get("/timeline") == b"<p>kept</p>"
        assert post("/api/reset", {})["files"] == []
    finally:
        at.shutdown()


def test_deep_and_wide_forest(spark):
    deep = [(0, "f", k, "s", f"2025-01-01 {k // 60 % 24:02d}:{k % 60:02d}", "", f"d{k}", [], f"deep {k}", f"<{k}@d>", f"<{k - 1}@d>" if k else "", []) for k in range(2000)]
    wide = [(1, "g", k, "s", "2025-01-02", "", f"w{k:04d}", [], f"wide {k}", f"<{k}@w>", "<0@w>" if k else "", []) for k in range(500)]
    loop = [(2, "h", k, "s", "", "", "", [], f"loop {k}", f"<{k}@l>", f"<{(k + 1) % 3}@l>", []) for k in range(3)]
    walked = forest.forest(spark.createDataFrame(deep + wide + loop, MESSAGE)).cache()
    rows = walked.orderBy("root_place", "place").collect()
    assert [r.depth for r in rows] == [*range(2000), 0, *[1] * 499] and [r.title for r in rows] == [*(f"d{k}" for k in range(2000)), *(f"w{k:04d}" for k in range(500))]
    assert {r.root for r in rows} == {"mid:0@d", "mid:0@w"} and forest.stranded(spark.createDataFrame(loop, MESSAGE), walked).count() == 3


def test_lost_messages(spark):
    rows = spark.createDataFrame([(0, "f", 0, ANN, "", "", "S", [], "one", "<1@x>", "", []), (0, "f", 1, ANN, "", "", "", [], "two", "", "", []), (1, "g", 0, ANN, "", "", "S", [], "ONE", "", "", [])], MESSAGE)
    states = spark.createDataFrame([(0, "f", True), (1, "g", False)], "file_id long, name string, redundant boolean")
    report = forest.verify_no_loss(rows, states).first()
    assert (report.n_lost, report.collapsed, report.ok) == (1, 1, False) and [r.said for r in forest.lost(rows, states).collect()] == ["Ann Lee: (no subject)"]


def test_classes_of_files(spark):
    corpus = [("a", "xyz"), ("b", "xyz"), ("c", "x"), ("d", ""), ("e", ""), ("f", "q")]
    keys = spark.createDataFrame([(k, bytearray(ch.encode())) for k, (_, s) in enumerate(corpus) for ch in s], "file_id long, key binary")
    parts = contain.containment(keys, spark.createDataFrame([(k, n) for k, (n, _) in enumerate(corpus)], "file_id long, name string"))
    assert {(r.name, r.by_name) for r in contain.links(parts).collect()} == {("c", "a"), ("d", "a"), ("d", "c"), ("d", "f")}
    assert {r.name: (r.redundant, r.n_supersets) for r in contain.states(parts).collect()} == {"a": (False, 0), "b": (True, 0), "c": (True, 1), "d": (True, 3), "e": (True, 3), "f": (False, 0)}


def test_view_statistics(spark):
    rows = [("t", k, f"T{k}" if k != 4 else "", f"2025-01-0{9 - k}", "AB"[k % 2], 2 + k % 2) for k in range(9)] + [("u", 9, "", "soon", "A", 2)]
    events = spark.createDataFrame(rows, "tab string, pos long, title string, date string, category_label string, importance int")
    text = {r.tab: r.text for r in timeline.overview(events).collect()}
    assert text["t"] == "This timeline tracks 9 events spanning Jan 1, 2025 – Jan 9, 2025. Work splits across 2 tracks — A (5), B (4) — led by A. Key milestones: “T8”; “T7”; “T6”; “T5” and 4 more."
    assert text["u"] == "This timeline tracks 1 event. 1 event flagged as key."
    view = {r.tab: r for r in timeline.view_overview(events, timeline.filtered(events.withColumn("category", F.col("category_label")), "B"), "B").collect()}
    assert view["t"].text == "Filtered to B: showing 4 of 9 events, Jan 2, 2025 – Jan 8, 2025. All in B. Key milestones: “T7”; “T5”; “T3”; “T1”." and (view["t"].n, view["t"].n_key) == (4, 4)
    assert view["u"].text == "No events match the current filters."


def test_attachments_of_both_kinds(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"title": "T", "tabs": [{"id": "t", "groups": [{"label": "G", "events": [{"title": "x", "date": "2025", "attachments": ["plain", {"name": "linked", "href": "/f"}, {"name": "bad", "href": "javascript:x"}], "source": {"type": "manual", "by": "me"}}]}]}]}))
    page, n = render.render_timeline(*render.load_events(spark, str(path)))
    assert n == 1 and '<span class="chip">plain</span><a class="chip" href="/f">linked</a><span class="chip">bad</span>' in page and "added by me" in page


def test_unique_messages_know_their_first_place(spark):
    rows = spark.createDataFrame([(0, "f", 0, "s", "2025-01-02", "", "", [], "x", "", "", []), (1, "g", 0, "s", "2025-01-01", "", "", [], "x", "", "", [])], MESSAGE)
    one = unique.unique_messages(rows).first()
    assert (one.name, one.first_seen.file_id, one.occurrences) == ("g", 0, 2) and file_keys(rows).count() == 2


def test_scratch_tables_go(spark):
    from strandline import scratch

    t = scratch.table(spark.range(3).toDF("x"), "some")
    path = scratch._paths[t]
    p, fs = scratch._file_system(spark, path)
    assert t.count() == 3 and fs.exists(p)
    scratch.drop(t, spark.range(1))
    assert not fs.exists(p)
    with scratch.passing():
        u = scratch.table(spark.range(2).toDF("x"), "some")
        p, fs = scratch._file_system(spark, scratch._paths[u])
        assert u.count() == 2
    assert not fs.exists(p)


def test_scratch_needs_a_shared_folder():
    from strandline import scratch

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId, getConf = "spark://host:7077", "app", staticmethod(lambda: Conf())

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_edits_are_kept_by_title(spark, tmp_path):
    events = spark.createDataFrame([("e1", "t", 0, "2025", "one", "a"), ("e2", "t", 1, "2025", "two", "a"), ("e3", "t", 2, "2025", "three", "a")], "id string, tab string, pos long, date string, title string, category string")
    edits = timeline.Edits(spark, str(tmp_path))
    assert edits.apply("My Title", events).count() == 3
    edits.save("My Title", 1, spark.createDataFrame([("e1", True, None), ("e2", None, "2.0")], "id string, deleted boolean, title string"), spark.createDataFrame([("m1", "t", 9, "own")], "id string, tab string, pos long, title string"))
    edits.save("my-title!", 2, spark.createDataFrame([("e1", False, None), ("e2", None, "2.1"), ("e2", None, None), ("m2", True, None)], "id string, deleted boolean, title string"), spark.createDataFrame([("m1", "t", 9, "own again"), ("m2", "t", 9, "gone")], "id string, tab string, pos long, title string"))
    assert {r.id: r.title for r in edits.apply("MY TITLE", events).collect()} == {"e1": "one", "e2": "2.1", "e3": "three", "m1": "own again"}
    assert edits.apply("another", events).count() == 3


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], MESSAGE)
    files = spark.createDataFrame([], "file_id long, name string")
    assert contain.verdict(file_keys(none), files).collect() == [] and contain.links(contain.containment(file_keys(none), files)).collect() == []
    only_empty = spark.createDataFrame([(1, "b"), (2, "a")], "file_id long, name string")
    assert {r.name: r.superseded_by for r in contain.verdict(file_keys(none), only_empty).collect()} == {"a": [], "b": ["a"]}
    walked = forest.forest(none)
    assert walked.collect() == [] and forest.forest_lines(walked).collect() == [] and unique.unique_messages(none).collect() == []
    states = contain.redundancy(file_keys(none), files)
    assert forest.verify_no_loss(none, states).first().line == "Collapsed 0 files -> 0 branches; 0 unique messages, 0 lost."
    events = timeline.message_events(unique.unique_messages(none).withColumn("path", F.col("name")))
    assert timeline.conversations(events).collect() == [] and timeline.axis_dots(events).collect() == [] and timeline.reading_places(events).collect() == []
    page, n = render.render_timeline("T", events)
    assert n == 0 and "<title>T</title>" in page
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.add(none, files.withColumn("path", F.col("name")), "t")["messages_added"] == 0 and store.stats(s.read()).first().asDict() == {"files": 0, "messages": 0, "attachments": 0}
    assert workspace.working_set(spark, [])[0].messages.count() == 0


def test_nulls_count_as_empty(spark):
    rows = spark.createDataFrame([(1, "f", 0, None, None, None, None, None, None, None, None, None), (2, "g", 0, "", "", "", "", [], "", "", "", [])], MESSAGE)
    assert unique.duplicate_counts(rows).first().asDict() == {"total": 2, "unique_messages": 1, "duplicates": 1}
    assert {r.name: r.redundant for r in contain.redundancy(file_keys(rows), rows.select("file_id", "name")).collect()} == {"f": False, "g": True}
    (line,) = forest.forest_lines(forest.forest(rows)).collect()
    assert line.line == "* (no subject)  (Unknown)"
    (event,) = timeline.message_events(unique.unique_messages(rows).withColumn("path", F.col("name"))).collect()
    assert (event.title, event.badge, event.summary, event.importance) == ("(no subject)", "Unknown", "", 1)


def test_streams(spark, archive, tmp_path):
    from strandline.streaming import ingest

    name = "streamed_messages"
    ingest.stream_messages(spark, str(archive)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    whole = sources.read_directory(spark, str(archive), pattern="*.txt").messages
    of = lambda df: sorted((r.name, r.msg_idx, r.subject, r.body) for r in df.collect())
    assert of(spark.table(name)) == of(whole) and len(of(whole)) == 5
    run = lambda: ingest.stream_exports(spark, str(archive), str(tmp_path / "store"), str(tmp_path / "c2"), stamp="s", files_per_batch=2).awaitTermination()
    run()
    s = store.Store(spark, str(tmp_path / "store"))
    told = store.stats(s.read()).first().asDict()
    assert told == {"files": 4, "messages": 5, "attachments": 1} and len(s.version()["parts"]) == 2
    run()  # no new files: nothing is taken in again
    assert store.stats(s.read()).first().asDict() == told and s.version()["number"] == 2


def test_answers_of_a_broken_run_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"e{k + 1}", "2025-01-01", "A", f"T{k}", "x", "body") for k in range(7)], "pos long, id string, date string, from string, title string, snippet string, body string")
    asked = []

    def classify(messages):
        asked.append([m["id"] for m in messages])
        if len(asked) == 2:
            raise ConnectionError
        return {"title": "", "categories": [{"id": "", "label": "Dogs & cats"}, {"id": "b", "label": "B"}], "assignments": [{"id": m["id"], "category": "b", "importance": 1, "summary": None} for m in messages]}

    book = str(tmp_path / "ledger")
    with pytest.raises(ConnectionError):
        organize.classify_messages(rows, classify, 3, book)
    out = organize.classify_messages(rows, classify, 3, book)
    assert asked == [["e1", "e2", "e3"], ["e4", "e5", "e6"], ["e4", "e5", "e6"], ["e7"]]  # the first answer wasn't asked for again
    categories, assignments = organize.classification_frames(spark, out)
    assert [(r.id, r.label, r.raw) for r in categories.orderBy("ordinal").collect()] == [("dogs-cats", "Dogs & cats", ""), ("b", "B", "b")]
    assert sorted((r.id, r.category) for r in assignments.collect()) == [(f"e{k}", "b") for k in range(1, 8)] and out.title is None
    said = spark.createDataFrame([(0, "{}"), (1, '{"stop_reason": "max_tokens", "content": []}')], "batch long, body string")
    assert [(r.batch, r.problem) for r in organize.problems(said).orderBy("batch").collect()] == [(0, "shape"), (1, "cut")]
