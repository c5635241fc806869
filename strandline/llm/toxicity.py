"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of four hashes: the word, two beginnings and its end. Hashes that
too few of the sample's texts have (LEAST_TEXTS) keep a zero vector, so unknown words are silent. Filters of several
widths slide over the words, each filter's largest response over the whole text is kept, and a logistic layer makes a
score of these. All is trained in numpy on a bounded sample of labelled rows (max_rows); scores are calibrated on rows
that the fit left out. Thresholds are calibrated by language on the same rows: they decide the extra column flagged and
are no part of the score, which comes from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import raw, read, small_batches
from strandline.llm.labelled import folds, platt, remainder, sample, sigmoid

#: Labelled rows that a fit takes at most.
MAX_ROWS = 8000
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
BUCKETS, DIM, WIDTHS, FILTERS, HASHES = 1 << 15, 12, (1, 2, 3), 8, 4
EPOCHS, PATIENCE, RATE, BATCH = 12, 3, 0.01, 32
#: Share of a text's words that a training step sees. Max pooling learns from the strongest word alone; without it the next one must do.
SEEN = 0.5
LEAST_TEXTS = 3
#: A language has a threshold of its own from so many calibration rows of each label on.
LEAST_BY_LANGUAGE = 10
#: Words convolved at once and words a worker remembers: bounds of memory.
SLICE, REMEMBER = 1 << 14, 200_000

#: ASCII letters lower-cased, digits and bytes beyond ASCII; all else separates words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def buckets(word: bytes) -> tuple[int, ...]:
    h = xxhash.xxh32_intdigest
    return h(word, 1) % BUCKETS, BUCKETS + h(word[:4], 2) % BUCKETS, 2 * BUCKETS + h(word[:6], 3) % BUCKETS, 3 * BUCKETS + h(word[-5:], 4) % BUCKETS


@dataclass
class Network:
    embedding: np.ndarray  # HASHES * BUCKETS, DIM
    filters: list[np.ndarray]  # by width: width, DIM, FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(rng.normal(0, 0.1, (HASHES * BUCKETS, DIM)).astype(np.float32), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def pool(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses of all filters and where they are. vectors: words, DIM; at least as many as the widest filter."""
        best, where = [], []
        for f, b in zip(self.filters, self.bias, strict=True):
            width = len(f)
            top, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
            for k in range(0, len(vectors) - width + 1, SLICE):
                part = vectors[k : k + SLICE + width - 1]
                y = sum(part[j : len(part) - width + 1 + j] @ f[j] for j in range(width))
                p = y.argmax(0)
                v = y[p, np.arange(FILTERS)]
                better = v > top
                top[better], at[better] = v[better], p[better] + k
            best.append(top + b)
            where.append(at)
        return np.maximum(np.concatenate(best), 0), where

    def raw(self, vectors: np.ndarray) -> float:
        return float(self.pool(vectors)[0] @ self.out + self.offset)


def _padded(ids: np.ndarray) -> int:
    return max(len(ids), max(WIDTHS))


def fit(texts: list[bytes], label: np.ndarray, language: list[str], seed: int = 11) -> Network:
    """Adam on the filters and the output layer, Adagrad on the embeddings. One class only or no rows: a constant score."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if len(label) < 20 or label.min() == label.max():
        net.out[:] = 0
        share = float(np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3))
        net.offset = float(np.log(share / (1 - share)))
        return net
    known: dict[bytes, tuple[int, ...]] = {}
    docs = []
    for text in texts:
        rows = [known.get(w) or known.setdefault(w, buckets(w)) for w in words_of(text)]
        docs.append(np.array(rows, np.int32).reshape(-1, HASHES))
    held = folds(len(docs))
    often = np.zeros(HASHES * BUCKETS, np.int64)
    for i in np.nonzero(~held)[0]:
        often[np.unique(docs[i])] += 1
    silent = often < LEAST_TEXTS
    net.embedding[silent] = 0
    train = np.nonzero(~held)[0]
    params = [*net.filters, *net.bias, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    squares = np.full(len(net.embedding), 1e-3, np.float32)
    net.offset, step = float(np.log(label.mean() / (1 - label.mean()))), 0

    def vectors(ids: np.ndarray) -> np.ndarray:
        out = np.zeros((_padded(ids), DIM), np.float32)
        if len(ids):
            out[: len(ids)] = net.embedding[ids].sum(1)
        return out

    def loss() -> float:
        p = sigmoid(np.array([net.raw(vectors(docs[i])) for i in np.nonzero(held)[0]]))
        return float(-np.log(np.clip(np.where(label[held] == 1, p, 1 - p), 1e-9, 1)).mean())

    best, since = (np.inf, None), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for k in range(0, len(train), BATCH):
            grads = [np.zeros_like(p) for p in params]
            touched: list[np.ndarray] = []
            deltas: list[np.ndarray] = []
            d_offset = 0.0
            batch = train[k : k + BATCH]
            for i in batch:
                x = vectors(docs[i])
                shown = rng.random(len(docs[i])) < SEEN
                x[: len(shown)][~shown] = 0
                pooled, where = net.pool(x)
                d = float(sigmoid(pooled @ net.out + net.offset) - label[i]) / len(batch)
                grads[-1] += d * pooled
                d_offset += d
                back = d * net.out * (pooled > 0)
                for j, (f, at) in enumerate(zip(net.filters, where, strict=True)):
                    g = back[j * FILTERS : (j + 1) * FILTERS]
                    grads[len(net.filters) + j] += g
                    for r in range(len(f)):
                        grads[j][r] += x[at + r].T * g
                        inside = at + r < len(docs[i])
                        inside[inside] = shown[(at + r)[inside]]
                        rows = docs[i][(at + r)[inside]]
                        touched.append(rows.ravel())
                        deltas.append(np.repeat((f[r].T * g[:, None])[inside], HASHES, 0))
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.offset -= RATE * d_offset
            rows = np.concatenate(touched)
            order = np.argsort(rows, kind="stable")
            ids, first = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(np.concatenate(deltas)[order], first)
            total[silent[ids]] = 0
            squares[ids] += (total**2).mean(1)
            net.embedding[ids] -= 0.1 * total / np.sqrt(squares[ids])[:, None]
        now = loss()
        since += 1
        if now < best[0]:
            best, since = (now, ([p.copy() for p in params], net.offset, net.embedding.copy())), 0
        if since >= PATIENCE:
            break
    for p, good in zip(params, best[1][0], strict=True):
        p[...] = good
    net.offset, net.embedding = best[1][1], best[1][2]
    raw_held = np.array([net.raw(vectors(docs[i])) for i in np.nonzero(held)[0]])
    net.scale = platt(raw_held, label[held])
    p = sigmoid(net.scale[0] * raw_held + net.scale[1])
    calibrate(net, p, label[held], [language[i] for i in np.nonzero(held)[0]])
    return net


def best_threshold(p: np.ndarray, label: np.ndarray) -> float:
    """Where F1 is largest: midway between two neighbouring scores."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + label.sum())
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)


def calibrate(net: Network, p: np.ndarray, label: np.ndarray, language: list[str]) -> None:
    """Thresholds by language; one for all where a language has too few calibration rows."""
    if 0 < label.sum() < len(label):
        net.threshold = best_threshold(p, label)
    languages = np.array(["" if x is None else x for x in language])
    for x in np.unique(languages):
        own = languages == x
        if min(label[own].sum(), (1 - label[own]).sum()) >= LEAST_BY_LANGUAGE:
            net.thresholds[str(x)] = best_threshold(p[own], label[own])


class Scorer:
    """A network with the vectors of words seen, in a table of bounded size."""

    def __init__(self, net: Network):
        self.net = net
        self.table = np.zeros((REMEMBER, DIM), np.float32)
        self.rows: dict[bytes, int] = {}

    def _new(self, word: bytes) -> int:
        row = self.rows[word] = len(self.rows)
        self.table[row] = self.net.embedding[list(buckets(word))].sum(0)
        return row

    def score(self, text: bytes) -> float:
        words = words_of(text)
        distinct = set(words)
        if len(distinct) > REMEMBER // 2:  # a text with more words than fit: without the table
            x = np.concatenate([self.net.embedding[np.array([buckets(w) for w in words[k : k + SLICE]])].sum(1) for k in range(0, len(words), SLICE)])
        else:
            if len(self.rows) + len(distinct) > REMEMBER:
                self.rows.clear()
            for w in [w for w in distinct if w not in self.rows]:
                self._new(w)
            x = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        if len(x) < max(WIDTHS):
            x = np.concatenate([x.reshape(-1, DIM), np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        return float(sigmoid(np.float64(self.net.scale[0] * self.net.raw(x) + self.net.scale[1])))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """Fit on labelled rows with crc32(doc_id) mod 4 other than 2, max_rows at most."""
    more = ("lang",) if "lang" in docs.columns else ()
    rows = sample(docs, labels, "toxic", MODULUS, HELD_OUT, max_rows, more).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(r.text))
    return fit([r.text.encode() for r in rows], np.array([r.label for r in rows], float), [r.lang if more else None for r in rows])


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, score, threshold (of the row's language), flagged: one row for each row of docs.

    Null or empty text: the score of a text without words. Null or unknown language: the threshold for all. Null doc_id
    stays null, repeated rows stay. Empty table: no rows. Other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in small_batches(batches):
            scores = [scorer.score(t) for t in raw(batch.column(1))]
            limits = [shared.value.thresholds.get(x or "", shared.value.threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(limits, pa.float64())], ["doc_id", "score", "threshold"])

    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, "doc_id long, score double, threshold double").withColumn("flagged", F.col("score") >= F.col("threshold"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "flagged")
