"""Labelled rows for the classifiers: a bounded sample, without the rows that are held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """text, label (0 or 1) and further columns of docs for at most max_rows labelled documents that aren't held out.

    Which ones, the hash of doc_id decides. One row for each labelled doc_id. Null labels and doc_ids don't count; of differing labels of a document the
    majority counts, 1 on a tie.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label].cast("double").alias("value")).where("label_id is not null and value is not null")
    known = known.where(remainder(F.col("label_id"), modulus) != held_out).groupBy("label_id").agg((F.avg("value") >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    # At most max_rows rows of two numbers: safe to broadcast. Of a doc_id that occurs more than once the smallest text
    # counts, so the join can't multiply what goes to the driver.
    rows = docs.join(F.broadcast(known), docs["doc_id"].cast("long") == known["label_id"])
    taken = F.struct(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c].cast("string").alias(c) for c in more])
    one = rows.groupBy("label_id").agg(F.min(taken).alias("row"), F.first("label").alias("label"))
    return one.select("row.text", "label", *[f"row.{c}" for c in more])


def folds(n: int, share: int = 5) -> np.ndarray:
    """True for the rows that a fit leaves out to stop in time and to calibrate: every share-th."""
    return np.arange(n) % share == share - 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(raw: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton's method; held near 1 and 0 by a small penalty and by smoothed targets."""
    a, b = 1.0, 0.0
    if not len(raw) or label.min() == label.max():
        return a, b
    ones = label.sum()
    label = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        g = np.array([((p - label) * raw).sum() + 0.1 * (a - 1), (p - label).sum() + 2 * b])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)
