"""Weighted sampling: expanded look-ups, alias tables, and weighted orders by exponential scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import LUT_LIMIT


def check_weights(weights: Sequence[int], limit: int | None = None) -> int:
    """The sum of usable weights."""
    total = sum(weights)
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    if total <= 0:
        raise ValueError("some weight must be positive")
    if limit is not None and total > limit:
        raise ValueError(f"weights sum to more than {limit}")
    return total


def lut(weights: Sequence[int]) -> np.ndarray:
    """Each index as often as its weight says."""
    check_weights(weights, LUT_LIMIT)
    return np.repeat(np.arange(len(weights)), weights)


def lut_column(weights: Column) -> Column:
    """The same as an array expression."""
    return F.flatten(F.transform(weights, lambda w, i: F.array_repeat(i, w.cast("int"))))


def alias_table(weights: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(prob, alias, total): a uniform slot i gives i with probability prob[i] / total, else alias[i].

    Weights are scaled by the number of slots, so that every value is whole.
    """
    if not len(weights):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    total, n = check_weights(weights), len(weights)
    if total * n >= 1 << 63:
        raise OverflowError("weights are too large for this many slots")
    scaled = [int(w) * n for w in weights]
    prob, alias = np.full(n, total, np.int64), np.arange(n)
    low = [i for i, x in enumerate(scaled) if x < total]
    high = [i for i, x in enumerate(scaled) if x >= total]
    while low and high:
        i, j = low.pop(), high[-1]
        prob[i], alias[i] = scaled[i], j
        scaled[j] -= total - scaled[i]
        if scaled[j] < total:
            low.append(high.pop())
    return prob, alias, total


def alias_table_real(weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(prob in 0..1, alias) for real weights."""
    w = np.asarray(weights, float)
    if not len(w):
        return w, np.zeros(0, np.int64)
    if not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be finite, from 0, and not all 0")
    scaled = (w * len(w) / w.sum()).tolist()
    prob, alias = np.ones(len(w)), np.arange(len(w))
    low, high = [i for i, x in enumerate(scaled) if x < 1], [i for i, x in enumerate(scaled) if x >= 1]
    while low and high:
        i, j = low.pop(), high[-1]
        prob[i], alias[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        if scaled[j] < 1:
            low.append(high.pop())
    return prob, alias


def alias_pick(prob: np.ndarray, alias: np.ndarray, total: float, slot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Indexes for uniform slots (0..n-1) and uniform levels (0..total); -1 for an empty table."""
    if not len(prob):
        return np.full(len(slot), -1)
    return np.where(level < prob[slot], slot, alias[slot])


def alias_mass(prob: np.ndarray, alias: np.ndarray, total: int) -> np.ndarray:
    """What the table gives each index, times slots: equal to weight * slots for a right table."""
    kept = np.minimum(prob, total)
    return kept + np.bincount(alias, total - kept, minlength=len(prob)).astype(np.int64)


def weighted_score(weight: Column, u: Column) -> Column:
    """Exponential score of a row for u in (0, 1): the least scores are a weighted sample; weight 0 is last."""
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def weighted_order(df: DataFrame, weight: str, u: str, *keys: str, tie: str, drop_zero: bool = False) -> DataFrame:
    """``df`` with ``place`` from 1 in weighted order within ``keys``."""
    rows = df.where(F.col(weight) > 0) if drop_zero else df
    order = Window.partitionBy(*keys).orderBy(weighted_score(F.col(weight), F.col(u)), tie)
    return rows.withColumn("place", F.row_number().over(order))


def weighted_sample(df: DataFrame, k: int, weight: str, u: str, *keys: str, tie: str) -> DataFrame:
    """The first ``k`` in weighted order of each group, zero weights left out; Spark keeps k rows of a task before it shuffles."""
    return weighted_order(df, weight, u, *keys, tie=tie, drop_zero=True).where(F.col("place") <= k)


def reservoir(df: DataFrame, k: int, weight: str, seed: int, key: str) -> DataFrame:
    """A weighted sample of ``k`` rows of all, by a seeded hash of ``key``: each task keeps k rows."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return df.where(F.col(weight) > 0).withColumn("score", weighted_score(F.col(weight), u)).orderBy("score", key).limit(k).drop("score")


def seeded_shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
