"""Bounded labelled samples and folds, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, text, label, part of at most `most` labelled documents outside the held-out fold.

    The sample is fixed by hashes of the ids, so it is the same in every run. A document with several
    labels takes the largest. `part` is 0 or 1, for estimates that must not see each other's rows.
    Of rows of `docs` that repeat an id the one with the smallest text is taken, so there are at most `most`
    rows, as there are on the broadcast side.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("_h", F.xxhash64(F.lit(11), "doc_id")).orderBy("_h", "doc_id").limit(most)
    part = F.pmod(F.shiftright("_h", 7), F.lit(2)).cast("int")
    taken = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id", "label", part.alias("part"))), "doc_id")
    return taken.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if not len(y):
        return w
    for _ in range(rounds):
        p = sigmoid(a @ w)
        slope = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return float((ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(1, good.sum() * (~good).sum()))
