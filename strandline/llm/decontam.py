"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK embedding copies a sequence along a random walk: at each of 3n steps it writes the word it stands on and, by a
random bit that depends on the step and the word, stays or moves on. Two sequences at a small edit distance meet in most
steps, so edit distance becomes Hamming distance. A signature samples a few steps of one walk; many walks are repeated
until an item at the allowed edit distance is found with the wanted probability (target_recall). How many, is estimated
on the benchmark itself, for each class of lengths, by editing its items at random as far as allowed. Windows whose
signature equals an item's are verified by the exact edit distance of words. A class that would need more than MOST_WALKS
is not left to chance: its windows are all verified.

Windows are of an item's length, at every place of a text that can hold a match: with at most k edits among n words, some
ceil((n - k) / (k + 1)) consecutive words stay as they are, so places without such a run of any item need no window.
This rules out nothing that could match. Only then random walks are run, on windows around the runs: they thin out the
verification, which for a text with many common runs is the dear part.

The benchmark goes to executors in a broadcast, in blocks of at most BLOCK_BYTES of text, whatever its size; documents are
read once for each block and never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import mix64, raw, read, small_batches

SIMILARITY, TARGET_RECALL = 0.8, 0.98
SAMPLED, LEAST_WALKS, MOST_WALKS = 5, 24, 400
#: Words of an item beyond which its windows are verified without walks, whose cost grows with the square of its length.
LONGEST_WALK = 256
BLOCK_BYTES = 8 << 20
SEED = 97
ODD = 0x9E3779B97F4A7C15

#: Letters and digits of ASCII, lower-cased, and bytes beyond ASCII; all else separates words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_WORD).split()


def allowed(n: int, similarity: float) -> int:
    """The edits that an item of n words may have."""
    return int(n * (1 - similarity) + 1e-9)


def run_length(n: int, k: int) -> int:
    """Words of an item that stand together unchanged in any text within k edits."""
    return max(1, -(-(n - k) // (k + 1)))


def symbols(numbers: np.ndarray) -> np.ndarray:
    """The hashes of word numbers, also of -1 to -3, that random bits are made of. None is zero, whose bits would all be zero: a walk would never leave that word."""
    return mix64(numbers.astype(np.int64).view(np.uint64) + np.uint64(ODD))


def edit_places(item: list[int], words: np.ndarray) -> tuple[int, int, int]:
    """The smallest edit distance of the item to any stretch of words, and that stretch (start, end); the earliest end, then the longest.

    Sellers' algorithm, a row of the table at a time; words and item as numbers.
    """
    m = len(words)
    row, start = np.zeros(m + 1, np.int32), np.arange(m + 1, dtype=np.int32)
    at = np.arange(m + 1, dtype=np.int32)
    for k, w in enumerate(item, 1):
        new, begin = row + 1, start.copy()  # without the item's word
        swap = row[:-1] + (words != w)
        better = (swap < new[1:]) | (swap == new[1:]) & (start[:-1] < begin[1:])
        new[1:], begin[1:] = np.where(better, swap, new[1:]), np.where(better, start[:-1], begin[1:])
        # With further words of the text: the cheapest value to the left plus one for each step.
        key = (new.astype(np.int64) - at) * (m + 2) + begin
        best = np.minimum.accumulate(key)
        row = (best // (m + 2) + at).astype(np.int32)
        start = (best % (m + 2)).astype(np.int32)
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


def stretches(item: list[int], words: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of separate stretches of words within `most` edits of the item: the best one, then those beside it."""
    out, parts = [], [(0, len(words))]
    while parts:
        a, b = parts.pop()
        if b - a < max(1, len(item) - most):
            continue
        edits, start, end = edit_places(item, words[a:b])
        if edits <= most and end > start:
            out.append((edits, a + start, a + end))
            parts += [(a, a + start), (a + end, b)]
    return sorted(out, key=lambda x: x[1])


@dataclass
class Items:
    """A block of the benchmark, as executors need it."""

    ids: list[int]
    words: list[list[int]]
    vocabulary: dict[bytes, int]
    walks: dict[int, int]  # by item length; 0: windows are verified without walks
    similarity: float

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.k = [allowed(len(w), self.similarity) for w in self.words]
        longest = max((n for n, walks in self.walks.items() if walks), default=0)
        self.seeds = rng.integers(1, 1 << 63, (max(self.walks.values()), 3 * longest), np.uint64) * np.uint64(2) + np.uint64(1)  # multipliers of the random bits, by walk and step
        self.by_run: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        runs = defaultdict(list)
        for i, (w, k) in enumerate(zip(self.words, self.k, strict=True)):
            q = run_length(len(w), k)
            codes = self.run_codes(np.array(w), q)
            runs[q] += [(int(c), i, o) for o, c in enumerate(codes)]
        for q, found in runs.items():
            found.sort()
            self.by_run[q] = tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        # Signatures of all items, by length: the sampled steps and each walk's table of signatures.
        self.steps, self.signatures = {}, {}
        lengths = defaultdict(list)
        for i, w in enumerate(self.words):
            lengths[len(w)].append(i)
        for n, members in lengths.items():
            if not self.walks[n]:
                continue
            self.steps[n] = np.sort(rng.integers(0, 3 * n, (self.walks[n], SAMPLED)), axis=1)
            codes = self.signature(np.array([self.words[i] for i in members]), n)  # items, walks
            order = np.argsort(codes, axis=0, kind="stable")
            self.signatures[n] = np.array(members)[order].T, np.take_along_axis(codes, order, 0).T

    @staticmethod
    def run_codes(words: np.ndarray, q: int) -> np.ndarray:
        n = len(words) - q + 1
        code = np.zeros(max(n, 0), np.uint64)
        for j in range(q):
            code = mix64(code + words[j : j + n].astype(np.uint64) + np.uint64(1))
        return code

    def signature(self, windows: np.ndarray, n: int) -> np.ndarray:
        """A number for each window and walk, made of the words at the walk's sampled steps. windows: rows of n word numbers."""
        steps, walks = self.steps[n], self.walks[n]
        at = np.zeros((len(windows), walks), np.int64)
        out = np.zeros((len(windows), walks), np.uint64)
        rows = np.arange(len(windows))[:, None]
        wide = symbols(np.concatenate([windows, np.full((len(windows), 1), -2)], axis=1))  # -2: beyond the end
        taken = np.zeros(walks, np.int64)
        for step in range(int(steps.max()) + 1):
            symbol = wide[rows, np.minimum(at, n)]
            while True:
                now = (taken < SAMPLED) & (steps[np.arange(walks), np.minimum(taken, SAMPLED - 1)] == step)
                if not now.any():
                    break
                out[:, now] = mix64(out[:, now] + symbol[:, now] + np.uint64(1))
                taken[now] += 1
            at += (symbol * self.seeds[:walks, step] >> np.uint64(63)).astype(np.int64)  # the word's bit in this walk and step
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers in the benchmark; -1 for words that it doesn't have."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def places(self, numbers: np.ndarray) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
        """The starts of windows that hold a run of an item, at each start where that item could begin: by length, and by
        item for lengths without walks."""
        out: tuple[dict[int, set[int]], dict[int, set[int]]] = defaultdict(set), defaultdict(set)
        known = numbers >= 0
        for q, (codes, item, offset) in self.by_run.items():
            if len(numbers) < q:
                continue
            whole = known[: len(known) - q + 1].copy()
            for j in range(1, q):
                whole &= known[j : len(known) - q + 1 + j]
            inside = np.nonzero(whole)[0]
            if not len(inside):
                continue
            mine = np.zeros(len(inside), np.uint64)
            for j in range(q):
                mine = mix64(mine + numbers[inside + j].astype(np.uint64) + np.uint64(1))
            lo, hi = np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")
            for p, a, b in zip(inside[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for i, o in zip(item[a:b].tolist(), offset[a:b].tolist(), strict=True):
                    n, k = len(self.words[i]), self.k[i]
                    # A window may reach beyond the text by as many words as the item may lack.
                    starts = range(max(p - o - k, -k), min(p - o + k, len(numbers) - n + k) + 1)
                    (out[0][n] if self.walks[n] else out[1][i]).update(starts)
        return out

    def find(self, numbers: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the items that the text holds within their edits, one for each separate stretch."""
        windows, hits = self.places(numbers)  # hits: the starts of an item's windows that are to be verified
        for n, found in windows.items():
            starts = sorted(found)
            members, own = self.signatures[n]
            for k in range(0, len(starts), 256):
                part = np.array(starts[k : k + 256])
                cells = part[:, None] + np.arange(n)
                w = np.where((cells >= 0) & (cells < len(numbers)), numbers[np.clip(cells, 0, len(numbers) - 1)], -3)
                codes = self.signature(w, n)
                for walk in range(self.walks[n]):
                    lo = np.searchsorted(own[walk], codes[:, walk], "left")
                    hi = np.searchsorted(own[walk], codes[:, walk], "right")
                    for x in np.nonzero(hi > lo)[0]:
                        for i in members[walk][lo[x] : hi[x]].tolist():
                            hits[i].add(int(part[x]))
        out = []
        for i, found in sorted(hits.items()):
            n, k = len(self.words[i]), self.k[i]
            starts = np.array(sorted(found))
            for near in np.split(starts, np.nonzero(np.diff(starts) > n + 2 * k)[0] + 1):
                first = max(0, int(near[0]) - k)
                out += [(i, edits, first + a, first + b) for edits, a, b in stretches(self.words[i], numbers[first : int(near[-1]) + n + k], k)]
        return out


def walks_needed(words: list[list[int]], similarity: float, target_recall: float, trials: int = 40) -> dict[int, int]:
    """By item length: walks after which an item with as many random edits as allowed shares a signature with the wanted probability.

    Lengths of one power of two are a class. In each the share of walks that meet, in the worst tenth of the trials,
    stands for all. 0 where more than MOST_WALKS would be needed.
    """
    classes = defaultdict(list)
    for w in words:
        classes[len(w).bit_length()].append(w)
    out: dict[int, int] = {}
    for size, members in classes.items():
        rng = np.random.default_rng(SEED + size)
        met = []
        for i in rng.integers(0, len(members), trials):
            item = list(members[i])
            n, k = len(item), allowed(len(item), similarity)
            if n > LONGEST_WALK:
                met.append(0.0)
                continue
            edited = list(item)
            for _ in range(k):
                at, kind = int(rng.integers(0, len(edited))), int(rng.integers(0, 3))
                edited[at : at + (kind != 1)] = [] if kind == 0 and len(edited) > 1 else [-1]
            probe = Items([0], [item], {}, {n: 200}, similarity)
            whole = np.array([(edited + [-3] * n)[:n]])
            met.append(float((probe.signature(whole, n) == probe.signature(np.array([item]), n)).mean()))
        p = float(np.quantile(met, 0.1))
        need = np.ceil(np.log(1 - min(target_recall, 0.9999)) / np.log(1 - min(p, 0.999))) if p > 0 else np.inf
        walks = 0 if need > MOST_WALKS else max(LEAST_WALKS, int(need))
        out |= {len(w): 0 if len(w) > LONGEST_WALK else walks for w in members}
    return out


def blocks(benchmark: DataFrame, similarity: float, target_recall: float) -> Iterator[Items]:
    """The benchmark in blocks of BLOCK_BYTES. Items without words can't be found; repeated items are found once each."""
    rows, size = [], 0

    def block() -> Items:
        vocabulary: dict[bytes, int] = {}
        numbered = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for _, ws in rows]
        return Items([i for i, _ in rows], numbered, vocabulary, walks_needed(numbered, similarity, target_recall), similarity)

    for r in benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").orderBy("item_id").toLocalIterator():
        words = words_of(r.text)
        if not words:
            continue
        rows.append((r.item_id, words))
        size += len(r.text)
        if size >= BLOCK_BYTES:
            yield block()
            rows, size = [], 0
    if rows:
        yield block()


SCHEMA = "doc_id long, item_id long, edits int, item_words int, similarity double, start_word long, end_word long"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, benchmark item it holds and separate stretch that holds it, with columns of SCHEMA; documents without any have no row.

    A document holds an item if a stretch of its words is within (1 - similarity) x item words of it, in edits of words:
    of overlapping stretches the one with the fewest edits counts, of ties the one that ends first, then the longest.
    Case and ASCII punctuation don't count. Null or empty texts hold nothing and are held by nothing. Null ids stay null,
    repeated rows have rows of their own. Empty tables: no rows. Other columns are not read. No shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in blocks(benchmark, similarity, target_recall):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in small_batches(batches):
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for i, edits, start, end in items.find(items.numbers(words_of(text or ""))):
                        n = len(items.words[i])
                        found.append((doc_id, items.ids[i], edits, n, 1 - edits / n, start, end))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item."""
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, similarity, target_recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in small_batches(batches):
                texts = batch.column(at).cast(pa.string()).to_pylist()
                yield batch.filter(pa.array([not items.find(items.numbers(words_of(t or ""))) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))
