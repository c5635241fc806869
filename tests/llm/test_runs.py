"""Periodic runs against a quadratic search, on words and through the query."""

import hashlib
import random
import re
import zlib

import numpy as np

from strandline.llm import queries, runs


def brute(w):
    """(start, length, period) of all runs, by start, then period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def some_words(r):
    out = []
    while r.random() < 0.9:
        unit = [r.choice("ab" if r.random() < 0.5 else "abcdef") for _ in range(r.randint(1, 6))]
        out += unit * r.choice([1, 1, 3, 4, 5, 9]) + unit[: r.randint(0, len(unit))]
    return out


def test_words(monkeypatch):
    r = random.Random(1)
    for trial in range(600):
        monkeypatch.setattr(runs, "GROUP_PAIRS", r.choice([1, 50, 1 << 20]))
        monkeypatch.setattr(runs, "TABLE_WORDS", r.choice([0, 4096]))
        runs._table.cache_clear()
        texts = [some_words(r) for _ in range(r.randint(1, 5))]
        for w, (found, stay) in zip(texts, runs._group([[x.encode() for x in w] for w in texts]), strict=True):
            assert found == brute(w) and [x.decode() for x in stay] == kept(w, brute(w))
    runs._table.cache_clear()


def test_hashes_that_lie(monkeypatch):
    """All stretches look alike: the comparison of words finds the runs that the points lie in."""
    monkeypatch.setattr(runs.PrefixHashes, "equal", lambda self, i, j, length: np.ones(len(i), bool))
    assert list(runs._group([[b"x", *[b"a", b"b"] * 5, b"y"]])) == [([(1, 10, 2)], [b"x", b"a", b"b", b"y"])]


def test_query(spark, tmp_path):
    r = random.Random(2)
    texts = [None, "", " \n", "a " * 6, "a " * 5, "one", "é \x0bé\té é é\r\né é", "x y " * 4, "long " * 1500, *(" ".join(some_words(r)) for _ in range(60)), *(" ".join(f"w{k % 97}" for k in range(n)) for n in range(30, 130, 2))]
    rows = [(k, t, 1, "s") for k, t in enumerate(texts)] + [(3, "a " * 6, 1, "s"), (None, "b " * 8, 1, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op11_periodic_runs"](spark, str(tmp_path))
    expected = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = brute(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(kept(w, found)))]
        expected.append((d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    key = lambda x: (x[0] is None, x[0], x[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
