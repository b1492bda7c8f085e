"""Bounded labelled samples and small fits shared by the trained scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Rows without id or label are left out; an id labelled twice has its larger label; of an id with several texts the one with the smallest
    hash counts. So the result has at most ``most`` rows, as has the broadcast side.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("doc_id", "label", F.col("one.text").alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton steps; prior only where one class is missing."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return np.append(np.zeros(d), np.log(rate / (1 - rate)))
    a = np.column_stack([x, np.ones(n)])
    w = np.zeros(d + 1)
    penalty = np.append(np.full(d, ridge * n / 100), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
