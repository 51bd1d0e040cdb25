"""What the trained scorers share: folds, bounded samples of labelled rows, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo `FOLDS`; 0 is held out. A NULL key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str, text: str) -> DataFrame:
    """(fold, text, y) of about `bound` labelled rows that are not held out, chosen by a hash of their key.

    With up to `bound` such rows it is all of them. Rows without a label, a key or words are not used; of
    rows that repeat a key each counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 0)).select(
        key, (F.col(label).cast("int") == 1).cast("int").alias("y")
    )
    total = known.count()
    if total > bound:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * bound / total))
    return (
        docs.select(key, F.col(text).cast("string").alias("text"))
        .join(known, key)
        .where(F.col("text").isNotNull() & (F.trim("text") != ""))
        .select(fold(key).cast("int").alias("fold"), "text", "y")
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of `x` and a last one for the constant, by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    if not len(y):
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
