"""A local page over a Workspace: upload exports, see the verdict, build a timeline of a selection, compare files.

One working set behind one lock; requests run one after another. What the routes answer, strandline.operators.workspace computes.
"""

from __future__ import annotations

import json
import mimetypes
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import workspace
from strandline.plans import render
from strandline.scratch import passing, table

EMPTY = "<!doctype html><meta charset='utf-8'><p>Nothing was built yet.</p>"
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>strandline</title><style>
body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:60rem;padding:0 1rem} li{margin:.2rem 0} .redundant{color:#777} iframe{width:100%;height:70vh;border:1px solid #ccc}
</style></head><body><h1>strandline</h1><p><input type="file" id="files" multiple> <button id="build">Build timeline</button> <button id="reset">Reset</button></p>
<p id="summary"></p><ul id="list"></ul><iframe id="page" src="/timeline"></iframe><script>
var get=function(id){return document.getElementById(id);};
function post(path,body){return fetch(path,{method:'POST',body:JSON.stringify(body)}).then(function(r){return r.json();});}
function show(s){get('summary').textContent=JSON.stringify(s.summary);get('list').replaceChildren.apply(get('list'),s.files.map(function(f){
 var li=document.createElement('li'),box=document.createElement('input');box.type='checkbox';box.checked=!f.redundant;box.value=f.name;li.className=f.redundant?'redundant':'';
 li.append(box,' '+f.name+(f.redundant?' (covered by '+f.coveredBy.join(', ')+')':'')+', '+f.messages+' messages');return li;}));}
get('files').onchange=function(){Promise.all([].map.call(get('files').files,function(f){return new Promise(function(done){var r=new FileReader();
 r.onload=function(){done({name:f.name,content:r.result.split(',')[1]||'',encoding:'base64'});};r.readAsDataURL(f);});})).then(function(x){return post('/api/upload',{files:x});}).then(show);};
get('build').onclick=function(){post('/api/build',{selected:[].map.call(document.querySelectorAll('#list input:checked'),function(b){return b.value;})}).then(function(){get('page').src='/timeline';});};
get('reset').onclick=function(){post('/api/reset',{}).then(show);};
fetch('/api/state').then(function(r){return r.json();}).then(show);
</script></body></html>"""


class Session:
    """What the routes answer, as plain objects."""

    def __init__(self, spark: SparkSession):
        self.work, self.lock = workspace.Workspace(spark), threading.Lock()

    def state(self) -> dict:
        w = self.work.working()
        with passing():
            states = table(workspace.file_states(w.messages, w.inputs), "states")
            rows, s = states.orderBy("name").collect(), workspace.summary(w.messages, states).first()
        files = [{"name": r.name, "messages": r.messages, "attachments": r.attachments, "redundant": r.redundant, "coveredBy": r.covered_by} for r in rows]
        total = {"files": s.files, "kept": s.kept, "redundant": s.redundant, "uniqueMessages": s.unique_messages, "duplicates": s.duplicates}
        return {"files": files, "hasTimeline": self.work.page is not None, "summary": total}

    def upload(self, records: list[dict]) -> dict:
        saved, skipped = self.work.save(records)
        return self.state() | {"saved": saved, "skipped": skipped}

    def build(self, names: list[str]) -> dict:
        chosen = self.work.spark.createDataFrame([(n,) for n in names], "name string")
        working = self.work.working()
        with passing():
            events, report = workspace.build(working, chosen)
            r = report.first()
            self.work.page = render.render_timeline("Selected threads", events, subtitle=r.subtitle, labels={"conversations": "Conversations"})[0] if r.ok else None
        return {"ok": True, "count": r["count"], "subtitle": r.subtitle} if r.ok else {"ok": False, "error": r.error}

    def file(self, name: str) -> dict:
        w = self.work.working()
        if w.files.where(F.col("name") == F.lit(name)).limit(1).count() == 0:
            return {"ok": False, "error": workspace.NO_SUCH_FILE}
        told = {"from": "sender", "to": "recipient", "date": "timestamp", "subject": "subject", "body": "body", "attachments": "attachments", "key": "key_id"}
        return {"ok": True, "name": name, "messages": [{k: r[c] for k, c in told.items()} for r in workspace.file_view(w.messages, name).collect()]}

    def load(self, page: str) -> dict:
        if page.strip():
            self.work.page = page
        return {"ok": bool(page.strip())}

    def reset(self) -> dict:
        self.work.reset()
        return self.state()

    def source(self, name: str) -> bytes | None:
        r = self.work.working().files.where(F.col("name") == F.lit(name)).select("content").first()
        return None if r is None else bytes(r.content)


class Handler(BaseHTTPRequestHandler):
    session: Session

    def log_message(self, *args) -> None:
        pass

    def answer(self, body: str | bytes | dict, kind: str = "text/html; charset=utf-8", code: int = 200) -> None:
        if isinstance(body, dict):
            body, kind = json.dumps(body), "application/json; charset=utf-8"
        data = body.encode() if isinstance(body, str) else body
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def missing(self) -> None:
        self.answer("Not found", "text/plain; charset=utf-8", 404)

    def do_GET(self) -> None:  # noqa: N802
        url, s = urlparse(self.path), self.session
        with s.lock:
            if url.path.startswith(f"{workspace.SOURCE}/"):
                name = unquote(url.path[len(workspace.SOURCE) + 1 :])
                data = s.source(name)
                return self.missing() if data is None else self.answer(data, mimetypes.guess_type(name)[0] or "application/octet-stream")
            routes = {"/": lambda: PAGE, "/timeline": lambda: s.work.page or EMPTY, "/api/state": s.state, "/api/file": lambda: s.file((parse_qs(url.query).get("name") or [""])[0])}
            return self.answer(routes[url.path]()) if url.path in routes else self.missing()

    def do_POST(self) -> None:  # noqa: N802
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "{}")
        except ValueError:
            body = {}
        s = self.session
        routes = {"/api/upload": lambda: s.upload(body.get("files") or []), "/api/build": lambda: s.build(body.get("selected") or []), "/api/load_timeline": lambda: s.load(body.get("html") or ""), "/api/reset": s.reset}
        with s.lock:
            return self.answer(routes[self.path]()) if self.path in routes else self.missing()


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"session": Session(spark)}))


def serve(spark: SparkSession, host: str, port: int) -> int:
    at = server(spark, host, port)
    print(f"http://{host}:{at.server_address[1]}/ (end with Ctrl-C)")
    try:
        at.serve_forever()
    except KeyboardInterrupt:
        pass
    return 0
