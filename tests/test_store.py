"""The store: levels of parts, lookups that read little, manifests that two writers can't both put."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from strandline.operators import store
from strandline.schema import MESSAGE


def batch(spark, number, rows):
    """rows: (path, body). One file for each path."""
    paths = sorted({p for p, _ in rows})
    messages = [(paths.index(p), p, k, "s", f"2025-01-01 10:{number:02d}", "", "", [f"{body}.pdf"], body, "", "", []) for k, (p, body) in enumerate(rows)]
    return spark.createDataFrame(messages, MESSAGE), spark.createDataFrame([(k, p, p) for k, p in enumerate(paths)], "file_id long, path string, name string")


def test_random_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 2)
    r = random.Random(8)
    s = store.Store(spark, str(tmp_path / "s"))
    held, seen = {}, set()
    for number in range(4):
        monkeypatch.setattr(store, "LOOKUP", r.choice([2, 512]))
        rows = [(f"/p{r.randint(0, 5)}", f"body {r.randint(0, 20)}") for _ in range(r.randint(1, 12))]
        counts = s.add(*batch(spark, number, rows), f"t{number}")
        paths, bodies = {p for p, _ in rows}, {b for _, b in rows}
        assert counts == {"added": len(paths - held.keys()), "refreshed": len(paths & held.keys()), "messages_added": len(bodies - seen), "messages_seen": len(rows) - len(bodies - seen)}
        held |= {p: {b for q, b in rows if q == p} for p in paths}
        seen |= bodies
    t = s.read()
    assert sorted(p["level"] for p in s.version()["parts"]) == [2]
    assert s.stats().first().asDict() == store.stats(t).first().asDict() == {"files": len(held), "messages": len(seen), "attachments": len(set().union(*held.values()))}
    keys = {r.key: r.body for r in t.messages.select("key", "body").collect()}
    found = t.file_messages.join(t.files, "file_id").select("path", "key").collect()
    assert sorted((r.path, keys[r.key]) for r in found) == sorted((p, b) for p, bs in held.items() for b in bs)
    assert t.files.agg(F.count_distinct("file_id"), F.max("file_id")).first() == (len(held), len(held) - 1)


def test_a_small_batch_reads_little(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.add(*batch(spark, 0, [(f"/p{k % 50}", f"body {k}") for k in range(6000)]), "t0")
    s._replace(s.version(), s.version()["parts"], 1)
    wanted = spark.createDataFrame([(bytearray(b"k" * 32),), (bytearray(b"\x00" * 32),)], "key binary")
    nothing = store.looked_up(s.parts().messages.select("key"), wanted, "key")
    assert scanned(nothing) == 0  # Bloom filters and statistics leave no row group
    some = s.parts().messages.select("key").limit(3)
    assert store.looked_up(s.parts().messages.select("key"), some, "key").count() == 3
    assert "PushedFilters: [Or(EqualTo(key" in nothing._jdf.queryExecution().toString() and "ReadSchema: struct<key:binary>" in nothing._jdf.queryExecution().toString()


def scanned(df):
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_two_writers(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.add(*batch(spark, 0, [("/p", "a")]), "t")

    def put(k):
        try:
            s._publish(2, str(k), [])
        except store.StoreConflict:
            return None
        return str(k)

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(put, range(40)) if k]
    assert len(won) == 1 and s.version()["batch"] == won[0]
    assert not [f for f in (tmp_path / "s" / "manifests").iterdir() if f.suffix == ".draft"]
    with pytest.raises(store.StoreConflict):
        s._publish(1, None, [])


def test_vacuum(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    for k in range(2):
        s.add(*batch(spark, k, [("/p", f"b{k}"), (f"/q{k}", "same")]), "t")
    before = s.read()
    s.compact()
    assert s.vacuum() == 0 and before.messages.count() == 3  # who reads an older manifest still finds its parts
    told = store.stats(s.read()).first()
    assert s.vacuum(retain=-5) == 2 and store.stats(s.read()).first() == told and len(s._manifests()) == 1
