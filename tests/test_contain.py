"""The verdict's sweep against the rule itself: nested, forked and equal sets, names that several files share."""

import random

import pytest

from strandline.operators import contain


def rule(files):
    """files: name and set of each. Redundant: another name's file has more of the same, or the same under a smaller name."""
    over = [[j for j, (m, t) in enumerate(files) if m != n and (s < t or s == t and m < n)] for n, s in files]
    kept = {k for k, o in enumerate(over) if not o}
    covered = [sorted(files[j][0] for j in o if j in kept) or sorted(files[j][0] for j in o) for o in over]
    return [(bool(o), c) for o, c in zip(over, covered, strict=True)]


def frames(spark, files):
    keys = spark.createDataFrame([(k, bytearray(str(x).encode())) for k, (_, s) in enumerate(files) for x in s], "file_id long, key binary")
    return keys, spark.createDataFrame([(k, n) for k, (n, _) in enumerate(files)], "file_id long, name string")


def chain(n, name):
    return [(name(k), set(range(k + 1))) for k in range(n)]


def some(r):
    full = [set(r.sample(range(40), r.randint(3, 20))) for _ in range(6)]
    sets = [set(r.sample(sorted(f), r.randint(0, len(f)))) if r.random() < 0.8 else f for f in r.choices(full, k=60)]
    names = r.choice([lambda k: f"n{k:03d}", lambda k: r.choice("abc"), lambda k: "one" if r.random() < 0.8 else f"n{k}"])
    return [(names(k), s) for k, s in enumerate(sets)]


def test_rule(spark):
    """Corpora without a common key are looked at in one run."""
    corpora = [some(random.Random(k)) for k in range(4)] + [chain(30, lambda k: f"d{k:02d}"), chain(30, lambda k: "inbox.mbox"), chain(20, lambda k: "ab"[k % 2]), [("a", {0}), ("a", {0, 1}), ("a", {0, 1, 2}), ("b", {0, 1})]]
    files = [(n, {(c, x) for x in s}) for c, corpus in enumerate(corpora) for n, s in corpus if s]
    check(spark, files)


def test_empty_sets(spark):
    check(spark, [("a", set()), ("a", set()), ("b", set()), ("a", {1})])
    check(spark, [("a", set())])


def check(spark, files):
    got = {r.file_id: (r.redundant, r.covered_by) for r in contain.covered(*frames(spark, files)).collect()}
    assert [got[k] for k in range(len(files))] == rule(files)


def test_every_round(spark, monkeypatch):
    """Rounds are never given up, and given up at once."""
    files = some(random.Random(99))
    keys, names = frames(spark, files)
    for progress in (1e-9, 2.0):
        monkeypatch.setattr(contain, "PROGRESS", progress)
        got = {r.file_id: r.redundant for r in contain.redundancy(keys, names).collect()}
        assert [got[k] for k in range(len(files))] == [redundant for redundant, _ in rule(files)]


@pytest.mark.parametrize("name", ["d%05d", "inbox%.0d.mbox"])
def test_nested_exports_make_few_rows(spark, monkeypatch, name):
    n, rows = 400, {}
    plain = contain.table

    def counted(df, what):
        out = plain(df, what)
        rows[what, len(rows)] = out.count()
        return out

    monkeypatch.setattr(contain, "table", counted)
    keys, names = frames(spark, chain(n, lambda k: name % (k if "5" in name else 0)))
    assert contain.redundancy(keys, names).where("redundant").count() == (n - 1 if "5" in name else 0)
    assert sum(k for (what, _), k in rows.items() if what not in ("keys", "set-keys")) <= 6 * n
