"""Conversation repair against all edits of short conversations, and the query against its SQL on hard rows."""

import itertools
import random
import re

import duckdb

from strandline.llm import conversation, queries


def cheapest(turns):
    """Try every edit of (initial, fault) with up to two turns inserted anywhere."""
    best = None
    for edits in itertools.product("KuaD", repeat=len(turns)):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(turns) + 1):
            cost, audit, roles = 5 * sum(map(len, gaps)), "I" * len(gaps[0]), gaps[0]
            for (initial, fault), edit, gap in zip(turns, edits, gaps[1:], strict=True):
                if fault == "d" and edit != "D" or edit == initial:
                    break
                cost += {"K": 0, "D": 2}.get(edit, 1) + (5 if fault == "t" and edit != "D" else 0)
                audit += (edit if edit in "KD" else "R") + "I" * len(gap)
                roles += {"K": initial, "D": ""}.get(edit, edit) + gap
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def searched(turns, cut):
    """The operator's search over segments of the turns that end at the places of `cut`."""
    layer = conversation.first_layer()
    places = [0, *cut, len(turns)]
    for a, b in itertools.pairwise(places):
        layer = conversation.extended(layer, conversation.transfers([(i, f, 1) for i, f in turns[a:b]]))
    cost, pieces = conversation.cheapest(layer)
    state = conversation.START
    for (a, b), (source, piece) in zip(itertools.pairwise(places), pieces, strict=True):
        assert source == state
        for _, _, _, initial in conversation.replayed(source, piece, [(k, *turns[k], 1) for k in range(a, b)]):
            state = conversation.NEXT[state, initial] if initial else state
    return cost, "".join(piece for _, piece in pieces)


def test_against_all_edits():
    r = random.Random(3)
    for _ in range(150):
        turns = [(r.choice("suao"), r.choice("---td")) for _ in range(r.randint(1, 3))]
        assert searched(turns, []) == cheapest(turns), turns


def test_segments():
    r = random.Random(4)
    for _ in range(400):
        turns = [(r.choice("suao"), r.choice("---td")) for _ in range(r.randint(2, 40))]
        cut = sorted(r.sample(range(1, len(turns)), r.randint(1, min(5, len(turns) - 1))))
        assert searched(turns, cut) == searched(turns, [])
        joined = conversation.first_layer()
        copies = [(i, "d" if f == "d" else f, r.choice([1, 1, 3])) for i, f in turns]
        joined = conversation.extended(joined, conversation.transfers(copies))
        spread = [t for i, f, n in copies for t in [(i, f), *[(i, "d")] * (n - 1)]]
        cost, pieces = conversation.cheapest(joined)
        assert (cost, "".join(p for _, p in pieces)) == searched(spread, [])


def hard_rows():
    r = random.Random(5)
    said = ["Yes.", "No", "Why?", "a b!  ", "", " \t\x0b", "x\n", "Fine.\n", "…", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, r.choice([t, t, -t, None]), r.choice(roles), r.choice(said) if r.random() < 0.6 else f"Turn {t}.") for c in [*range(25), None] for t in range(r.randint(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else "tool", f"Word {t % 60}" + ("." if t % 7 else "")) for t in range(120)]
    rows += [(98, 3, "user", "Again.")] * 30 + [(97, None, None, None)] * 2
    r.shuffle(rows)
    return rows


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation, "SEGMENT_BITS", 3)
    kind = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(*x, "k", 1, "a") for x in hard_rows()], kind + ", key string, at long, audit string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.queries()["op12_conversation_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.sql(conversation.OP12_SQL)
    assert out.columns == expected.columns
    order = lambda x: (x[0] is None, x[0])
    assert sorted(map(tuple, out.collect()), key=order) == sorted(expected.fetchall(), key=order)


def test_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Who?"), (1, 2, "user", "Who?"), (1, 3, "tool", "Me."), (2, None, "user", " ")]
    turns, report = conversation.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [(r.conv_id, r.turn, r.edit, r.role, r.text) for r in turns.orderBy("conv_id", "at", "place").collect()] == [(1, 1, "K", "user", "Who?"), (1, 3, "R", "assistant", "Me.")]
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.cost, r.audit) for r in report.collect()} == {1: (0, 0, 1, 0, 5, "DKDR"), 2: (0, 1, 0, 0, 2, "D")}
    turns, report = conversation.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert turns.collect() == report.collect() == []
