"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting of the logistic loss: in each round every feature gets one shallow tree on its own bins, fitted
to the residual, and the tree is added into that feature's lookup table. When the main effects no longer help the rows
left out, the pairs of features that explain most of the residual get tables of their own, boosted in the same cyclic
way by trees with one cut on each of the two. A score is an intercept plus one table entry for each feature and pair.

Features are counts over the whole text: bytes by class, words, lines. They are computed on executors, in batches; the
driver fits on a bounded sample of labelled rows (max_rows).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import raw, read, small_batches
from strandline.llm.labelled import folds, platt, remainder, sample, sigmoid

#: Labelled rows that a fit takes at most.
MAX_ROWS = 8000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
BINS, COARSE, LEAVES, RATE, ROUNDS, PATIENCE, PAIRS = 48, 8, 4, 0.1, 300, 20, 8

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "stutter", "log_line_words", "lines_again", "space", "upper", "digit",
    "punctuation", "symbol", "bar", "non_ascii", "sentence_ends", "symbol_ends",
)
_PLAIN = b".,;:!?'\"()-"
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate((b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(48, 58)), _PLAIN, bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _PLAIN), b"|", bytes(range(128, 256))), 1):
    _CLASS[list(_members)] = _k


def features(text: bytes) -> list[float]:
    """The features of a text, in the order of FEATURES. No words: zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, by_byte, 8) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    ends = by_byte[46] + by_byte[33] + by_byte[63]
    symbol_ends = sum(w[-1] in b"#$%&*|<>=~^@" for w in words)
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 14).mean()), float((lengths < 4).mean()), len(counts) / n, max(counts.values()) / n, stutter / n,
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), *map(float, by_class[[1, 2, 3, 4, 5, 6, 7]]), ends / n, symbol_ends / n,
    ]


@dataclass
class Additive:
    """The fitted model: cuts and table by feature, tables by pair (on coarser cuts)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, k], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.raw(x) + self.scale[1])


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles; a value on which much of the sample sits gets a bin of its own."""
    points = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)
    return np.unique(np.concatenate([points, np.nextafter(points, np.inf)]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values of a small regression tree on ordered bins with these sums of gradient and curvature."""
    gain = lambda a, b: a * a / (b + 1.0)
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            left, right = (G[at] - G[a], H[at] - H[a]), (G[b] - G[at], H[b] - H[at])
            win = np.where((left[1] > 0.5) & (right[1] > 0.5), gain(*left) + gain(*right) - gain(G[b] - G[a], H[b] - H[a]), 0)
            k = int(np.argmax(win))
            if win[k] > best[0]:
                best = (win[k], int(at[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and values by cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    top, side = G[:-1, -1:], G[-1:, :-1]
    quads = [(G[:-1, :-1], H[:-1, :-1]), (top - G[:-1, :-1], H[:-1, -1:] - H[:-1, :-1]), (side - G[:-1, :-1], H[-1:, :-1] - H[:-1, :-1])]
    quads.append((G[-1, -1] - sum(q[0] for q in quads), H[-1, -1] - sum(q[1] for q in quads)))
    win = sum(a * a / (b + 1.0) for a, b in quads)
    if not win.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(win)), win.shape)
    values = [float((a / (b + 1.0))[i, j]) for a, b in quads]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(win[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1.0)), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting. One class only or no rows: a constant score, the share of label 1 (a half without rows)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Additive(intercept=float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    out = folds(len(y))
    model.cuts = [_cuts(x[~out, k], BINS) for k in range(x.shape[1])]
    model.coarse = [_cuts(x[~out, k], COARSE) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    f = np.full(len(y), model.intercept)
    loss = lambda: float(-np.log(np.clip(np.where(y[out] == 1, sigmoid(f[out]), 1 - sigmoid(f[out])), 1e-9, 1)).mean())

    def boost(parts: list) -> None:
        """parts: (table, flat cell of each row, tree maker). Rounds go on until the rows left out gain no more; the best tables stay."""
        best, kept, since = loss(), [t.copy() for t, _, _ in parts], 0
        start = f.copy()
        for _ in range(ROUNDS):
            for table, cell, tree in parts:
                p = sigmoid(f[~out])
                g = np.bincount(cell[~out], y[~out] - p, table.size).reshape(table.shape)
                h = np.bincount(cell[~out], p * (1 - p), table.size).reshape(table.shape)
                step = RATE * tree(g, h)
                table += step
                f[:] += step.ravel()[cell]
            now = loss()
            best, kept, since = (now, [t.copy() for t, _, _ in parts], 0) if now < best - 1e-5 else (best, kept, since + 1)
            if since >= PATIENCE:
                break
        f[:] = start
        for (table, cell, _), good in zip(parts, kept, strict=True):
            table[...] = good
            f[:] += good.ravel()[cell]

    boost([(t, b, lambda g, h: _tree(g, h, LEAVES)) for t, b in zip(model.tables, bins, strict=True)])
    p = sigmoid(f[~out])
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        g = np.bincount(cell[~out], y[~out] - p, shape[0] * shape[1]).reshape(shape)
        h = np.bincount(cell[~out], p * (1 - p), shape[0] * shape[1]).reshape(shape)
        gains.append((_corner(g, h)[0], a, b, cell, shape))
    gains.sort(key=lambda t: -t[0])
    parts = [(np.zeros(shape), cell, lambda g, h: _corner(g, h)[1]) for _, _, _, cell, shape in gains[:PAIRS]]
    boost(parts)
    model.pairs = [(a, b, t) for (_, a, b, _, _), (t, _, _) in zip(gains[:PAIRS], parts, strict=True)]
    model.scale = platt(f[out], y[out])
    return model


def _features_frame(rows: DataFrame, columns: list[str]) -> DataFrame:
    names = ["text", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = [features(t) for t in raw(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.list_(pa.float64()))], [*columns, "x"])

    kinds = dict(rows.dtypes)
    return rows.select(*names).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Additive:
    """Fit on labelled rows with crc32(doc_id) mod 5 other than 0, max_rows at most."""
    rows = _features_frame(sample(docs, labels, "quality", MODULUS, HELD_OUT, max_rows), ["label"]).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the same fit in whatever order the rows come
    order = np.random.default_rng(7).permutation(order)
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of docs, from the text alone.

    Null or empty text: the score of a text without words. Null doc_id stays null, repeated rows stay. Empty table: no
    rows. Other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([features(t) for t in raw(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Additive, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([features(t) for t in raw(batch.column(at).cast(pa.string()))], float)
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
