"""Substring dedup: difference-cover anchors find long repeats, extension around the anchors makes them exact.

Word positions whose remainder by PERIOD lies in a difference cover are cover positions: for any two positions there is
one shift below PERIOD that puts both on cover positions. So two equal windows of `window` words hold equal anchors,
the window - PERIOD + 1 words from their common cover position on. Only anchors are hashed and compared over the
corpus, about a quarter of all positions.

A window can be repeated only if it holds an anchor that is; the anchors are extended to these windows, and each is
judged by a 95-bit hash of its whole word sequence: it is repeated if the hash occurs twice. That is a grouping, not a
comparison of pairs, so a passage in thousands of documents costs as much for each as one in two.

All is keyed by the text's hash, not by doc_id: equal texts have equal windows, and of a group of copies each task
hashes two. Hashes that a task meets again and again go on twice (Meetings), so a boilerplate passage or a text that
makes up a third of the corpus meets as some rows a task, not as one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Remembered, mix64, raw, read, small_batches
from strandline.scratch import drop, table

WINDOW, PERIOD = 35, 21
#: Keys shared by different texts that are broadcast at most; more of them are joined by a shuffle.
MOST_SHARED = 100_000
#: Hashed positions: the text's key, the hash and _pack()'s number.
ROWS = "key long, h long, z long"
#: Multipliers of the two rolling hashes, odd.
_B = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _B], np.uint64)


def difference_cover(period: int) -> list[int]:
    """The first smallest set of remainders whose differences give every remainder."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
        size += 1


class Hasher:
    """Rolling hashes over a text's words."""

    def __init__(self, window: int = WINDOW, period: int = PERIOD, remember: int = 200_000):
        if not 1 <= period <= window:
            raise ValueError("the period must not exceed the window")
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.cover = np.array(difference_cover(period))
        self.words = Remembered(xxhash.xxh64_intdigest, remember)
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverses = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            n = max(n, 1 << 14)
            for tables, bases in ((self.powers, _B), (self.inverses, _INVERSE)):
                for k in (0, 1):
                    steps = np.full(n, bases[k], np.uint64)
                    steps[0] = 1
                    tables[k] = np.cumprod(steps, dtype=np.uint64)

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def prefix(self, h: np.ndarray, which: int) -> np.ndarray:
        """Sums over the first words' hashes, from which each window's hash follows."""
        self._grow(len(h) + 1)
        if which:
            h = mix64(h + np.uint64(0xD6E8FEB86659FD93))
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.powers[which][: len(h)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, starts: np.ndarray, n: int, which: int) -> np.ndarray:
        return mix64((prefix[starts + n] - prefix[starts]) * self.inverses[which][starts])

    def cover_positions(self, n_words: int) -> np.ndarray:
        last = n_words - self.anchor
        if n_words < self.window:
            return np.empty(0, np.int64)
        out = (np.arange(0, last + 1, self.period)[:, None] + self.cover).ravel()
        return out[out <= last]

    def extend(self, anchors: np.ndarray, n_words: int) -> np.ndarray:
        """All starts of windows that hold one of the anchors, ascending."""
        mark = np.zeros(n_words + 2, np.int32)
        np.add.at(mark, np.maximum(anchors - (self.period - 1), 0), 1)
        np.add.at(mark, anchors + 1, -1)
        starts = np.nonzero(np.cumsum(mark) > 0)[0]
        return starts[starts <= n_words - self.window]


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """How many words the repeated windows cover, and the other words joined by one space."""
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    keep = np.cumsum(mark)[:-1] == 0
    return int(len(words) - keep.sum()), b" ".join([words[k] for k in np.nonzero(keep)[0]])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First values and lengths of the runs of consecutive integers in ascending values."""
    cut = np.nonzero(np.diff(values) != 1)[0] + 1
    first = np.concatenate([[0], cut]) if len(values) else cut
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


def _expand(first: list[int], length: list[int]) -> np.ndarray:
    return np.concatenate([np.arange(a, a + n) for a, n in zip(first, length, strict=True)]) if first else np.empty(0, np.int64)


def _spread(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix64(mix64(key.view(np.uint64)) + place.astype(np.uint64)).view(np.int64)


class Meetings:
    """What a task has given out of each hash, in a table of fixed size: how often it was seen, up to two.

    One row of a hash goes on under the hash itself, so that it meets other tasks' rows; a second one goes when the hash
    is first seen again, so that the first one is found. All later ones are known to be repeated and are spread by their
    own place. So a passage that is in every document meets as two rows a task, and no more often than a hash is pushed
    out of the table by another.
    """

    def __init__(self, bits: int = 20):
        self.mask = np.int64((1 << bits) - 1)
        self.hash, self.seen = np.zeros((1 << bits, 2), np.int64), np.zeros(1 << bits, np.int8)

    def rows(self, keys: list, at: list, hs: list, h2s: list | None = None) -> pa.RecordBatch:
        """A batch key, h, z of hashed positions."""
        key, place, h = np.concatenate(keys), np.concatenate(at), np.concatenate(hs)
        h2 = np.concatenate(h2s) if h2s is not None else np.zeros(len(h), np.int64)
        order = np.argsort(h)
        if ((h[order][1:] == h[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
            order = np.lexsort((h2, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        heads = np.nonzero(first)[0]
        several = np.diff(np.append(heads, len(h))) > 1
        lead = order[heads]  # one position of each distinct hash
        slot = h[lead] & self.mask
        before = np.where((self.hash[slot, 0] == h[lead]) & (self.hash[slot, 1] == h2[lead]), self.seen[slot], 0)
        self.hash[slot, 0], self.hash[slot, 1] = h[lead], h2[lead]
        self.seen[slot] = np.where((before > 0) | several, 2, 1)
        known, spread = np.ones(len(h), bool), np.ones(len(h), bool)
        known[lead] = several | (before > 0)
        spread[lead] = before == 2
        h = np.where(spread, _spread(key, place), h)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(_pack(place, h2, known), pa.int64())], ["key", "h", "z"])


def _pack(place: np.ndarray, h2: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A position, 31 bits of a second hash and whether it is known to be repeated, as one number: a short row sorts fast."""
    return place.astype(np.int64) << 32 | h2 << 1 | known


def _gather_runs(rows: DataFrame) -> DataFrame:
    """key, at -> key, first array<int>, length array<int>: ascending runs. A row is one text's, so its size is the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def out():
            first, length = _runs(np.unique(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([first], pa.list_(pa.int32())), pa.array([length], pa.list_(pa.int32()))], ["key", "first", "length"])

        done: list[pa.RecordBatch] = []
        for batch in batches:
            keys, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and keys[a] != key:
                    done.append(out())
                    parts = []
                key = int(keys[a])
                parts.append(at[a:b])
            if len(done) > 2000:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if parts:
            done.append(out())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, first array<int>, length array<int>")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows of Meetings.rows() -> key, at of those that are known to be repeated or whose hash occurs more than once.

    Rows are sorted by the first hash and run through; a run needs the memory of a batch, however long it is. Copies of a
    text give the same place under the same hash: of these one goes on from each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, {}  # the last first hash; second hash: one row of it (key, at) that hasn't been given out, or None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, h, z = (c.to_numpy() for c in batch.columns)
            at, h2, hit = z >> 32, z >> 1 & 0x7FFFFFFF, z & 1 == 1
            if ((h[1:] == h[:-1]) & (h2[1:] != h2[:-1])).any():  # different words under one first hash: side by side by the second
                order = np.lexsort((h2, h))
                key, h, at, h2, hit = key[order], h[order], at[order], h2[order], hit[order]
            same = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
            hit[1:] |= same
            hit[:-1] |= same
            extra = []
            if last == h[0]:
                begin = int(np.searchsorted(h, h[0], "right"))
                for other in np.unique(h2[:begin]).tolist():
                    if other in tail:
                        hit[:begin] |= h2[:begin] == other
                        if tail[other]:
                            extra.append(tail[other])
                            tail[other] = None
            out_key, out_at = key[hit], at[hit]
            if same.any():
                order = np.lexsort((out_at, out_key))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(out_key[order]) != 0) | (np.diff(out_at[order]) != 0)
                out_key, out_at = out_key[order][new], out_at[order][new]
            if extra:
                out_key, out_at = np.append(out_key, [k for k, _ in extra]), np.append(out_at, [a for _, a in extra])
            if last != h[-1]:
                last, tail = int(h[-1]), {}
            end = int(np.searchsorted(h, h[-1], "left"))
            for k in np.unique(h2[end:], return_index=True)[1].tolist():
                tail.setdefault(int(h2[end + k]), None if hit[end + k] else (int(key[end + k]), int(at[end + k])))
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_at, pa.int32())], ["key", "at"])

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key long, at int")


class Twice:
    """Says for a task's texts whether they are to be hashed: two copies are enough to show that a text is repeated."""

    def __init__(self, remember: int = 100_000):
        self.seen: dict[int, int] = {}
        self.remember = remember

    def wants(self, key: int) -> bool:
        n = self.seen.get(key, 0)
        if len(self.seen) >= self.remember and not n:
            self.seen.clear()
        self.seen[key] = n + 1
        return n < 2


def repeated_starts(texts: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """key, text -> key, first, length: for each distinct text with any, the starts of its repeated windows as runs."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, twice, meetings = Hasher(window, period), Twice(), Meetings()
        for batch in small_batches(batches, 256):
            keys, at, hs = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words = text.split() if twice.wants(key) else []
                starts = hasher.cover_positions(len(words))
                if len(starts):
                    keys.append(np.full(len(starts), key))
                    at.append(starts)
                    hs.append(hasher.hashes(hasher.prefix(hasher.word_hashes(words), 0), starts, hasher.anchor, 0).view(np.int64))
            if keys:
                yield meetings.rows(keys, at, hs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, twice, meetings = Hasher(window, period), Twice(), Meetings()
        for batch in small_batches(batches, 64):
            keys, at, hs, h2s = [], [], [], []
            for key, text, first, length in zip(batch.column(0).to_pylist(), raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not twice.wants(key):
                    continue
                words = text.split()
                starts = hasher.extend(_expand(first, length), len(words))
                each = hasher.word_hashes(words)
                keys.append(np.full(len(starts), key))
                at.append(starts)
                hs.append(hasher.hashes(hasher.prefix(each, 0), starts, window, 0).view(np.int64))
                h2s.append((hasher.hashes(hasher.prefix(each, 1), starts, window, 1) >> np.uint64(33)).astype(np.int64))
            if keys:
                yield meetings.rows(keys, at, hs, h2s)

    found = _repeated(texts.select("key", "text").mapInArrow(anchors, ROWS))
    found = table(_gather_runs(found), "anchors")
    held = texts.select("key", "text").join(found, "key")
    exact = _repeated(held.mapInArrow(windows, ROWS))
    return table(_gather_runs(exact), "repeated")


def with_key(texts: DataFrame, bits: int = 64) -> DataFrame:
    """texts plus key, a number for each distinct text: `bits` bits of its hash, and another hash for texts whose key is not theirs alone."""
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    keyed = texts.withColumn("key", F.shiftright(F.xxhash64("text"), 64 - bits)).withColumn("__alt", F.xxhash64(F.lit(1), "text"))
    shared = keyed.select("key", "__alt").groupBy("key").agg(F.min("__alt").alias("low"), F.max("__alt").alias("high")).where("low <> high").select("key", F.lit(True).alias("__shared"))
    shared = table(shared, "shared-keys")
    n = shared.count()  # none, or as many as 64 bits collide: 70 or so among 5e10 texts
    if not n:
        drop(shared)
        return keyed.drop("__alt")
    if n <= MOST_SHARED:
        shared = F.broadcast(shared)
    return keyed.join(shared, "key", "left").withColumn("key", F.when(F.col("__shared"), F.col("__alt")).otherwise(F.col("key"))).drop("__alt", "__shared")


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are cut at ASCII white space. A word goes if a window of `window` words that covers it also starts somewhere
    else, in the same text, another or a copy. Null or empty text, and texts shorter than a window: nothing goes. Null
    doc_id stays null; repeated rows are copies of each other. Empty table: no rows. Other columns are not read.
    Texts are told apart by 128 bits (those that share 64 get others) and windows by 95, so wrong joins are as unlikely
    as their collisions. key_bits: fewer bits in the first place, for tests.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = with_key(texts, key_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n_words, gone, kept = [], [], []
            for text, first, length in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                n, rest = kept_words(words, _expand(first, length), window) if first else (0, b" ".join(words))
                n_words.append(len(words))
                gone.append(n)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    runs = repeated_starts(texts, window, period)
    return texts.join(runs, "key", "left").select("doc_id", "text", "first", "length").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Words and windows one by one; a window's words are joined by a space, which no word holds.
OP10_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM texts)),
again AS (SELECT doc_id, p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (
  SELECT words.*, max(again.p) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN again USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""
