"""Conversation structure repair: the cheapest edits that give every conversation the roles (s?(ua)+)?.

Each conversation is read once by a Viterbi search over four states of the grammar: nothing yet, after the system's turn,
after a user's, after an assistant's. A layer holds, for each state, the least (cost, audit) of all ways to edit the turns
so far into a beginning that ends there; a turn is kept, gets another role or goes, and the layer is closed by inserting
at most two turns. Ways of equal cost to one layer have audits of which none begins another (the audit alone settles the
cost), so what comes later can't turn their order round, and the least audit of a layer is the least in the end.

A conversation of any length is cut into segments of consecutive turns. For each segment the search runs once from every
state, so segments are searched in parallel; the chain of segments is then folded by the same rule, on 16 entries a
segment. Texts take no part in this: the search sees role initials and faults, and texts meet the edits in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import read
from strandline.scratch import table

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a role's initial; what is missing isn't allowed.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: States in which a conversation may end.
FINAL = (START, ASSISTANT)
#: The initial of a turn that is inserted behind a state.
INSERTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL = ("su", "ua", "au")
#: Turns of one segment, as a power of two.
SEGMENT_BITS = 10

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
NONE, CUT, GONE = "-td"  # faults as the search sees them: none, truncated, to be deleted

Layer = list[tuple[int, str] | None]


def _better(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or b < a else a


def closed(layer: Layer) -> Layer:
    """The layer with up to two turns inserted behind it."""
    out = list(layer)
    for source, target in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        found = layer[source] if target == USER else out[source]
        if found is not None:
            out[target] = _better(out[target], (found[0] + COST[INSERT], found[1] + INSERT))
    return out


def stepped(layer: Layer, initial: str, fault: str, times: int) -> Layer:
    """The layer behind a turn that stands there `times` times; all but the first are copies, which must go."""
    out: Layer = [None] * 4
    for state, found in enumerate(layer):
        if found is None:
            continue
        cost, audit = found
        out[state] = _better(out[state], (cost + COST[DELETE], audit + DELETE))
        if fault == GONE:
            continue
        cost += TRUNCATED_COST if fault == CUT else 0
        if (state, initial) in NEXT:
            target = NEXT[state, initial]
            out[target] = _better(out[target], (cost, audit + KEEP))
        for role in "ua":
            if role != initial and (state, role) in NEXT:
                target = NEXT[state, role]
                out[target] = _better(out[target], (cost + COST[REROLE], audit + REROLE))
    if times > 1:
        out = [f and (f[0] + COST[DELETE] * (times - 1), f[1] + DELETE * (times - 1)) for f in out]
    return closed(out)


def transfers(turns: list[tuple[str, str, int]]) -> list[Layer]:
    """For each state before a segment the layer behind it."""
    out = []
    for state in range(4):
        layer: Layer = [None] * 4
        layer[state] = (0, "")
        for turn in turns:
            layer = stepped(layer, *turn)
        out.append(layer)
    return out


class Way(NamedTuple):
    """The way to a layer: what came before, the state it came from, and the audit of the last segment."""

    before: Way | None
    source: int
    piece: str


def _audit_less(a: Way, b: Way) -> bool:
    """Compare the audits of two ways over equally many segments from where they part."""
    x, y = [], []
    while a is not b:
        x.append(a.piece)
        y.append(b.piece)
        a, b = a.before, b.before
    return "".join(reversed(x)) < "".join(reversed(y))


def first_layer() -> list[tuple[int, Way] | None]:
    root = Way(None, START, "")
    return [f and (f[0], Way(root, START, f[1])) for f in closed([(0, ""), None, None, None])]


def extended(layer: list[tuple[int, Way] | None], segment: list[Layer]) -> list[tuple[int, Way] | None]:
    """The layer of ways behind one more segment."""
    out: list[tuple[int, Way] | None] = [None] * 4
    for source, held in enumerate(layer):
        for target, found in enumerate(segment[source]):
            if held is None or found is None:
                continue
            new = (held[0] + found[0], Way(held[1], source, found[1]))
            old = out[target]
            if old is None or new[0] < old[0] or new[0] == old[0] and _audit_less(new[1], old[1]):
                out[target] = new
    return out


def cheapest(layer: list[tuple[int, Way] | None]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and for each segment the state before it and its piece of the audit. What is inserted before the first turn leads the first piece."""
    best = None
    for state in FINAL:
        found = layer[state]
        if found is not None and (best is None or found[0] < best[0] or found[0] == best[0] and _audit_less(found[1], best[1])):
            best = found
    cost, way = best
    pieces: list[tuple[int, str]] = []
    while way.before is not None:
        pieces.append((way.source, way.piece))
        way = way.before
    pieces.reverse()
    lead = pieces.pop(0)[1]
    if pieces:
        pieces[0] = (START, lead + pieces[0][1])
    return cost, pieces


def replayed(state: int, piece: str, turns: list[tuple[int, str, str, int]]) -> Iterator[tuple[int, int, str, str | None]]:
    """(at, place, edit, initial) of the turns (at, initial, fault, times) of a segment; inserted turns stand before (place < 0) or behind one."""
    p, place = 0, -2

    def inserted(at: int) -> Iterator[tuple[int, int, str, str | None]]:
        nonlocal p, place, state
        while p < len(piece) and piece[p] == INSERT:
            role = INSERTED[state]
            yield at, place, INSERT, role
            state, p, place = NEXT[state, role], p + 1, place + 1

    yield from inserted(turns[0][0])
    for at, initial, _, times in turns:
        edit = piece[p]
        role = initial if edit == KEEP else INSERTED[state] if edit == REROLE else None
        yield at, 0, edit, role
        if role:
            state = NEXT[state, role]
        p, place = p + times, 1
        yield from inserted(at)


# ---- DataFrames


def _keyed(c: DataFrame) -> DataFrame:
    """key (a conversation's number as text, null apart from all), turn, role, text."""
    key = F.coalesce(F.concat(F.lit("c"), c["conv_id"].cast("string")), F.lit(""))
    return c.select(key.alias("key"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit(" ")).alias("text"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Equal turns as one row with a count, first fault, and a number `at` that grows along every conversation.

    Ranges of (conversation, turn, role, text) are sorted apart, so a conversation that holds most of all rows is spread
    over as many tasks as it has rows for.
    """
    blank = ~F.col("text").rlike(BLANK)
    turns = rows.select("key", "turn", "role", F.sha2("text", 256).alias("digest"), blank.alias("blank"), (~blank & ~F.col("text").rlike(ENDED)).alias("cut"))
    turns = table(turns.groupBy("key", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("times")), "turns")
    first = turns.groupBy(*[F.col(k).alias(f"f_{k}") for k in ("key", "role", "digest")]).agg(F.min(F.struct("turn")).alias("first"))
    same = (F.col("key") == F.col("f_key")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    turns = turns.join(first, same).select("key", "turn", "role", "digest", "times", fault.alias("fault"))
    order = ["key", "turn", "role", "digest"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def _segments(order: DataFrame) -> DataFrame:
    """One row for each segment of a conversation: its turns as the search sees them, in order."""
    letter = F.substring("role", 1, 1)
    initial = F.when(letter.isin(*ROLES), letter).otherwise(F.lit("o"))
    fault = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(NONE)
    turn = F.struct("at", initial.alias("initial"), fault.alias("fault"), "times")
    return order.groupBy("key", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _illegal(turns: list[dict]) -> int:
    pairs = sum(a["initial"] + b["initial"] not in LEGAL for a, b in zip(turns, turns[1:], strict=False))
    return pairs + sum(t["times"] - 1 for t in turns)


_FOUND = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_SEARCHED = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("ends", pa.string()), ("illegal", pa.int64()), ("layers", pa.list_(_FOUND))])
SEARCHED = "key string, segment long, ends string, illegal long, layers array<struct<cost:long,audit:string>>"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for r in part.to_pylist():
                turns = r["turns"]
                layers = [f and {"cost": f[0], "audit": f[1]} for layer in transfers([(t["initial"], t["fault"], t["times"]) for t in turns]) for f in layer]
                rows.append({"key": r["key"], "segment": r["segment"], "ends": turns[0]["initial"] + turns[-1]["initial"], "illegal": _illegal(turns), "layers": layers})
            yield pa.RecordBatch.from_pylist(rows, _SEARCHED)


_FOLDED = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("source", pa.int32()), ("piece", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
FOLDED = "key string, segment long, source int, piece string, cost long, illegal long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and segment; of a conversation only its ways are held."""
    key, segments, layer, illegal, last = None, [], first_layer(), 0, ""

    def done() -> pa.RecordBatch:
        cost, pieces = cheapest(layer)
        return pa.RecordBatch.from_pylist([{"key": key, "segment": s, "source": source, "piece": piece, "cost": cost, "illegal": illegal} for s, (source, piece) in zip(segments, pieces, strict=True)], _FOLDED)

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for r in batch.slice(at, 64).to_pylist():
                if r["key"] != key:
                    if key is not None:
                        yield done()
                    key, segments, layer, illegal, last = r["key"], [], first_layer(), 0, ""
                illegal += r["illegal"] + (bool(last) and last + r["ends"][0] not in LEGAL)
                last = r["ends"][1]
                segments.append(r["segment"])
                found = [f and (f["cost"], f["audit"]) for f in r["layers"]]
                layer = extended(layer, [found[k : k + 4] for k in range(0, 16, 4)])
    if key is not None:
        yield done()


_EDITS = pa.schema([("at", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("initial", pa.string())])
EDITS = "at long, place int, edit string, initial string"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = [x for r in batch.slice(at, 64).to_pylist() for x in replayed(r["source"], r["piece"], [(t["at"], t["initial"], t["fault"], t["times"]) for t in r["turns"]])]
            yield pa.RecordBatch.from_pylist([dict(zip(_EDITS.names, x, strict=True)) for x in rows], _EDITS)


class Repaired(NamedTuple):
    #: conv_id, at, place, turn, edit (K, R or I), role, text: what stands afterwards, in the order of at, place.
    turns: DataFrame
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation with turns.
    report: DataFrame


def repair(conversations: DataFrame) -> Repaired:
    """The cheapest repair of every conversation, and a report of its faults and edits.

    Order: turn (null first), then role, then the text's SHA-256. The first fault of a turn counts: blank (white space of
    ASCII alone), duplicate (role and text stand earlier in the conversation), truncated (doesn't end in . ! or ?). Blank
    and duplicate turns go. Null role or text: one space, so a null text is blank and a null role must change or go, like
    an empty role and any whose first letter isn't s, u or a. Null conv_id: one conversation of its own. Equal rows are
    copies of one turn. Empty table: no rows. Other columns are not read. The audit has one letter for each turn before
    and each turn inserted, so it is the one value that grows with its conversation.
    """
    rows = _keyed(conversations)
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias("conv_id")
    order = table(_ordered(rows), "turn-order")
    segments = table(_segments(order), "segments")
    searched = segments.mapInArrow(_search, SEARCHED)
    # Written, since the report and the edits read it.
    folded = table(searched.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_fold, FOLDED), "folded")

    edits = segments.join(folded.select("key", "segment", "source", "piece"), ["key", "segment"]).mapInArrow(_replay, EDITS).where(F.col("edit") != DELETE)
    edits = edits.join(order.select("at", "key", "turn", "role", "digest"), "at")
    # An equal text is one row here, however often it stands in the table.
    texts = rows.withColumn("digest", F.sha2("text", 256)).groupBy("key", "turn", "role", "digest").agg(F.first("text").alias("text"))
    texts = texts.select(*[F.col(k).alias(f"t_{k}") for k in ("key", "turn", "role", "digest")], "text")
    same = (F.col("key") == F.col("t_key")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("role") == F.col("t_role")) & (F.col("digest") == F.col("t_digest"))
    role = F.when(F.col("edit") == KEEP, F.col("role")).when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    turns = edits.join(texts, same).select(
        conv_id, "key", "at", "place", F.when(F.col("edit") != INSERT, F.col("turn")).alias("turn"), "edit", role.alias("role"), F.when(F.col("edit") == INSERT, F.lit("")).otherwise(F.col("text")).alias("text")
    )

    distinct = order.groupBy("key", "turn").agg(*[F.sum(F.when(c, n).otherwise(F.lit(0))).alias(name) for name, c, n in _counts()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    report = distinct.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(name).alias(name) for name, _, _ in _counts()])
    pieces = F.array_sort(F.collect_list(F.struct("segment", "piece")))
    found = folded.groupBy(F.col("key").alias("f_key")).agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("audit"))
    report = report.join(found, F.col("key") == F.col("f_key")).select(conv_id, "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repaired(turns, report)


def _counts() -> list[tuple[str, Column, Column]]:
    """Faults: when a row of equal turns has them, and how many."""
    fault, copies = F.col("fault"), F.col("times") - 1
    return [
        ("blank", fault == "blank", F.col("times")),
        ("duplicate", fault != "blank", F.when(fault == "duplicate", F.col("times")).otherwise(copies)),
        ("truncated", fault == "truncated", F.lit(1).cast("long")),
    ]


DIGESTS = "key string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and in order; one line is held at a time, so a conversation of any length fits."""
    key, h = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [h.hexdigest()]})

    for batch in batches:
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                h.update(b"\n")
            else:
                if h is not None:
                    yield done()
                key, h = k, hashlib.sha256()
            h.update(line.encode())
    if h is not None:
        yield done()


def digests(turns: DataFrame) -> DataFrame:
    """key and SHA-256 of the lines role:text of each conversation that has turns left. One digest is one chain, so one task reads a conversation, as a stream."""
    lines = turns.select("key", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "at", "place").select("key", "line")
    return lines.mapInArrow(_digest, DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults: by a hash of conversation and turn, rows go, lose their text or its stops, come twice or turn into a user's."""
    c = conversations
    said = lambda name: F.coalesce(c[name].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, report = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    out = report.join(digests(turns), "key", "left").drop("key").withColumnRenamed("conv_id", "r_conv_id")
    out = every.join(out, every["conv_id"].eqNullSafe(out["r_conv_id"]), "left")
    return out.select("conv_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (
  SELECT said.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM said, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damaged),
judged AS (
  SELECT conv_id, k, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
grammar(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(s, t, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']),
         (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
edits AS (
  SELECT conv_id, k, g.s, g.t, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, 'K' AS audit, [role || ':' || text] AS lines FROM judged j JOIN grammar g USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, k, g.s, g.t, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', [CASE g.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM judged j JOIN grammar g ON g.initial IN ('u', 'a') AND g.initial <> j.initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, k, s, s, 2, 'D', [] FROM judged, range(4) AS states(s)),
ways AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS k, t AS state, CAST(cost AS BIGINT) AS cost, audit, lines FROM (SELECT DISTINCT conv_id FROM judged) c, inserts WHERE s = 0
  UNION ALL
  SELECT * FROM (
    SELECT w.conv_id, w.k + 1, i.t AS state, w.cost + e.cost + i.cost AS cost, w.audit || e.audit || i.audit AS audit, w.lines || e.lines || i.lines AS lines
    FROM ways w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k + 1 AND e.s = w.state JOIN inserts i ON i.s = e.t) x
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM judged GROUP BY conv_id),
ends AS (
  SELECT w.* FROM ways w JOIN report r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.k WHERE w.state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, w.audit) = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
