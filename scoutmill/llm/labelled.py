"""Bounded samples of labelled rows, and the small logistic model that calibrates scores on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """Texts of at most ``per_class`` labelled ids of each class 0 and 1, as (doc_id, text, label, part).

    Ids are taken in the order of a hash, so the choice is the same on every
    run. The ids are at most ``2 * per_class`` rows, which is what bounds the
    broadcast; texts stay where they lie. ``part`` is a second hash in 0..99.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    pick = lambda c: rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(per_class)
    ids = pick(0).unionByName(pick(1))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(100)).cast("int"))


def class_counts(labels: DataFrame, label: str, usable: Column) -> dict[int, int]:
    """Rows of each class among all usable labels."""
    found = labels.where(usable & F.col(label).isin(0, 1)).groupBy(label).count().collect()
    return {int(r[0]): int(r[1]) for r in found}


@dataclass
class Logistic:
    """Weights over standardised features; plain lists, so that it ships to workers as it is."""

    mean: list[float]
    scale: list[float]
    weights: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.scale)
        margin = self.weights[0] + z @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit_logistic(features: np.ndarray, labels: np.ndarray, row_weights: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> Logistic:
    """Weighted ridge regression by Newton steps; with one class only, a constant score of its share."""
    width = features.shape[1]
    if len(labels) == 0 or labels.min() == labels.max():
        share = 0.5 if len(labels) == 0 else 0.99 if labels[0] else 0.01
        return Logistic([0.0] * width, [1.0] * width, [float(np.log(share / (1 - share)))] + [0.0] * width)
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.c_[np.ones(len(features)), np.clip((features - mean) / scale, -20, 20)]
    w, weights = row_weights / row_weights.sum(), np.zeros(width + 1)
    penalty = ridge * np.r_[0.0, np.ones(width)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
        slope = x.T @ (w * (labels - p)) - penalty * weights
        bend = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty + 1e-12)
        step = np.linalg.solve(bend, slope)
        weights += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean.tolist(), scale.tolist(), weights.tolist())
