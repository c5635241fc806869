"""Periodic runs of words: a harmonic grid of (period, point) pairs, common extensions from prefix hashes, exact check.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbouring word extends.
Where a run of period q lies, words q apart agree on at least 3 q places in a row, so one of the points 0, 3 q, 6 q, ...
is among them: n words have n/3 + n/6 + n/9 + ... pairs to look at. All pairs of many documents are extended at once:
words agree at the point and beside it, or the pair goes; a binary search over prefix hashes finds how far they agree to
both sides. What is long enough is compared word by word, so a hash that lies costs time and never a result.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import mix64, raw, read, small_batches

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words agree on this many periods in a row inside a run, so grid points may lie as far apart.
STRIDE = LEAST_EXPONENT - 1
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Words of the documents that are looked at together, and pairs of one long document.
GROUP_WORDS, GROUP_PAIRS = 1 << 17, 1 << 20
#: Documents up to this length take their pairs from one table, which is made once for a worker.
TABLE_WORDS = 4096

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def _pairs(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods of n words, for the periods first to last - 1."""
    q = np.arange(first, last, dtype=np.int64)
    points = (n - q - 1) // (STRIDE * q) + 1
    period = np.repeat(q, points)
    nth = np.arange(len(period), dtype=np.int64) - np.repeat(np.cumsum(points) - points, points)
    return nth * STRIDE * period, period


@functools.cache
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the longest document of the table, by the number of words from which on they are needed."""
    point, period = _pairs(TABLE_WORDS, 1, TABLE_WORDS // LEAST_EXPONENT + 1)
    needs = np.maximum(point + period + 1, LEAST_EXPONENT * period)
    order = np.argsort(needs, kind="stable")
    return point[order], period[order], needs[order]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of n words, in parts of bounded size."""
    if n < LEAST_WORDS:
        return
    if n <= TABLE_WORDS:
        point, period, needs = _table()
        upto = np.searchsorted(needs, n, side="right")
        yield point[:upto], period[:upto]
        return
    first, end = 1, n // LEAST_EXPONENT + 1
    while first < end:
        # Periods from `first` on have at most this many points each.
        last = min(end, first + max(1, GROUP_PAIRS // (n // (STRIDE * first) + 1)))
        yield _pairs(n, first, last)
        first = last


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


class PrefixHashes:
    """Hashes of all stretches of a sequence of word numbers, modulo two primes."""

    def __init__(self, words: np.ndarray):
        self.n, self.parts = len(words), []
        values = mix64(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for base, prime in zip(BASES, PRIMES, strict=True):
            p = np.uint64(prime)
            powers = _powers(base, prime, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values % p * powers[:-1] % p, out=sums[1:])
            self.parts.append((sums, powers, p))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from i and from j > i agree."""
        out = np.ones(len(i), bool)
        for sums, powers, p in self.parts:
            out &= (sums[i + length] - sums[i]) % p * powers[j - i] % p == (sums[j + length] - sums[j]) % p
        return out

    def _longest(self, most: np.ndarray, agree) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = agree(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._longest(self.n - j, lambda k: self.equal(i, j, k))

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree."""
        return self._longest(i, lambda k: self.equal(i - k, j - k, k))


def _compared(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and end of the stretch around `at` in which words a period apart agree, word by word."""
    differ = np.flatnonzero(words[:-period] != words[period:])
    k = np.searchsorted(differ, at)
    return int(differ[k - 1]) + 1 if k else 0, (int(differ[k]) if k < len(differ) else len(words) - period) + period


def _extended(words: np.ndarray, hashes: PrefixHashes, i: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and period of the runs that pairs of a point and a period lie in, compared word by word."""
    start, end = i - hashes.backward(i, i + q), i + q + hashes.forward(i, i + q)
    least = np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
    long = end - start >= least
    found = np.unique(np.stack([start[long], end[long], q[long], i[long]], axis=1), axis=0)
    # Of the periods of one stretch the smallest is its own; the others are its multiples.
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    for s, e, p, at in found[first].tolist():
        if not np.array_equal(words[s : e - p], words[s + p : e]):
            s, e = _compared(words, at, p)
        if e - s >= max(LEAST_WORDS, LEAST_EXPONENT * p):
            yield s, e, p


def find_runs(words: np.ndarray, documents: list[tuple[int, int]]) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.

    `documents` are (first word, number of words); a number that occurs nowhere else stands between two of them, so
    nothing agrees across it.
    """
    # At least three places in a row agree, so one beside the point does.
    padded = np.concatenate([[-1], words, [-2]])
    hashes: PrefixHashes | None = None
    rows: dict[tuple[int, int], int] = {}
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    parts = ((point + offset, period) for offset, n in documents for point, period in grid(n))
    for i, q in itertools.chain(parts, [(None, None)]):
        if i is not None:
            hit = np.flatnonzero(words[i] == words[i + q])
            i, q = i[hit], q[hit]
            beside = (padded[i] == padded[i + q]) | (padded[i + 2] == padded[i + q + 2])
            waiting.append((i[beside], q[beside]))
            held += len(waiting[-1][0])
        if held and (i is None or held >= GROUP_PAIRS):
            hashes = hashes or PrefixHashes(words)
            for s, e, p in _extended(words, hashes, *(np.concatenate(x) for x in zip(*waiting, strict=True))):
                rows[s, e] = min(p, rows.get((s, e), p))
            waiting, held = [], 0
    found = np.array([(s, e, p) for (s, e), p in rows.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _group(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """For each text its runs (start, length, period) and the words that stay."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    places: list[tuple[int, int]] = []
    at = 0
    for words in texts:
        places.append((at, len(words)))
        at += len(words) + 1
    codes = np.empty(at, np.int64)
    for k, ((offset, n), words) in enumerate(zip(places, texts, strict=True)):
        codes[offset : offset + n] = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
        codes[offset + n] = -3 - k
    found = find_runs(codes, places)
    cut = np.searchsorted(found[:, 0], [o for o, _ in places] + [at])
    for k, ((offset, n), words) in enumerate(zip(places, texts, strict=True)):
        own = found[cut[k] : cut[k + 1]]
        if not len(own):
            yield [], words
            continue
        own = own - np.array([offset, offset, 0])
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, own[:, 0] + own[:, 2], 1)
        np.add.at(edges, own[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        yield [(s, e - s, p) for s, e, p in own.tolist()], [words[x] for x in stay.tolist()]


def _rows(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    waiting: list[list[bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        waiting.append(text.split())
        size += len(waiting[-1])
        if size >= GROUP_WORDS or k + 1 == len(texts):
            for words, (found, stay) in zip(waiting, _group(waiting), strict=True):
                yield len(words), found, b" ".join(stay)
            waiting, size = [], 0


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what white space of ASCII parts, in whole texts. `collapsed` holds the words that lie in no run, or in none
    but in the first period of each, joined by one space. Null or empty text: no words, no runs, an empty collapsed text.
    Null doc_id stays null, repeated rows stay. Empty table: no rows. Other columns are not read. No shuffle; a worker
    holds the words of one long document, or of short ones up to GROUP_WORDS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in small_batches(batches):
            rows = list(_rows(raw(batch.column(1))))
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for _, found, _ in rows]
            columns = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array(runs, kind), pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared as whole numbers; ties: smallest start, then period. Null without one."""

    def better(best: Column, r: Column) -> Column:
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        earlier = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (a > b) | ((a == b) & earlier), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


WORD = r"[^\x20\x09-\x0D]+"


def planted(text: Column, doc_id: Column) -> Column:
    """The words of a text joined by spaces; every tenth document repeats a stretch of its words to its end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        unit = F.slice(words, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        return F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a))

    # As a lambda's argument the words are cut out once.
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), rewritten)
    return F.when((h % 10 == 0) & text.rlike(WORD), F.array_join(F.element_at(words, 1), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = collapse_runs(docs.select("doc_id", planted(F.coalesce(docs["text"], F.lit("")), docs["doc_id"]).alias("text")))
    out = out.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
