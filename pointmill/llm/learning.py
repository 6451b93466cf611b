"""Bounded labelled samples and small fits shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """``t, k, y``: the texts, ids and labels of rows whose ids are at most ``per_class`` of each class, never of held-out rows; of rows with
    one id that whose text has the least hash, so the sample has at most ``per_class`` rows of each class.

    The rows with the smallest hashes of their ids are taken. Their number bounds what is broadcast: an id and a label each. An id
    with several labels counts with the largest; null ids, labels and texts take no part.
    """
    known = labels.select(F.col(label_id_col).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), docs[id_col] == F.col("k")).select(F.col(text_col).cast("binary").alias("t"), F.col("k"), "y", *extra)
    # One row for each id: the one whose text has the least hash.
    return found.groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y", *extra)).alias("r")).select("r.t", "k", "r.y", *(f"r.{c}" for c in extra))


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, ridge: float = 1.0, intercept: bool = True, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept, if any, comes last and is not penalised."""
    a = np.column_stack([x, np.ones(len(x))]) if intercept else x
    w = np.ones(len(a)) if weight is None else weight
    penalty = np.full(a.shape[1], ridge)
    if intercept:
        penalty[-1] = 1e-6
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ beta)
        gradient = a.T @ (w * (y - p)) - penalty * beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        beta += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
