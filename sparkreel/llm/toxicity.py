"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of adjacent word pairs and of pairs with one word between.
Each coordinate has its own rate, and the L1 term leaves most weights at exactly zero, so that what is sent to the
executors is a short list of (bin, weight), of at most 2**BINS entries whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from . import textbytes as tb

BINS = 20
U64 = np.uint64


@dataclass(frozen=True)
class Model:
    """Sorted bins with a weight other than zero, their weights, and the bias."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bins, text of each) for words, pairs and pairs over one word of a block of texts; repeats included."""
    hashes, first = tb.words(data, offsets, tb.PUNCTUATED)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = [((hashes >> U64(64 - BINS)).astype(np.int64), owner)]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, U64(0x1B873593)), (2, U64(0xCC9E2D51))):
            if len(hashes) > gap:
                same = owner[gap:] == owner[:-gap]
                pair = tb.pair_hash(hashes[:-gap] + salt, hashes[gap:])
                out.append(((pair[same] >> U64(64 - BINS)).astype(np.int64), owner[gap:][same]))
    return out


def rows_of(column: pa.Array, used: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct bins of each text, of those that are ``used``."""
    for i, j, data, offsets in tb.blocks(column, tb.BLOCK_BYTES // 2):
        found = features(data, offsets)
        bins, owner = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        if used is not None:
            bins, owner = bins[used[bins]], owner[used[bins]]
        keys = np.unique((owner << BINS) | bins)
        cuts = np.searchsorted(keys >> BINS, np.arange(j - i + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (keys[a:b] & ((1 << BINS) - 1)).astype(np.int32)


def fit(column: pa.Array, labels: list[int], passes: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.2) -> Model:
    """FTRL-proximal over the texts in order, ``passes`` times.  No texts: every score is 0.5.

    A step moves a bin's sum by less than 1 while its weight is zero, so bins that too few of these texts have for ``passes`` steps
    each to exceed the L1 term keep a weight of exactly zero; they are left out at the start.
    """
    z, n = np.zeros((1 << BINS) + 1), np.zeros((1 << BINS) + 1)
    bias = 1 << BINS

    def weight(at: np.ndarray) -> np.ndarray:
        x = z[at]
        limit = np.where(at == bias, 0.0, l1)
        return np.where(np.abs(x) <= limit, 0.0, -(x - np.sign(x) * limit) / ((beta + np.sqrt(n[at])) / alpha + l2))

    texts = np.zeros(bias, np.int32)
    for r in rows_of(column):
        texts[r] += 1
    rows = [np.append(r, np.int32(bias)) for r in rows_of(column, texts * passes > l1)]
    for _ in range(passes):
        for at, y in zip(rows, labels, strict=True):
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    bins = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(bins, weight(bins), float(weight(np.array([bias]))[0]))


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of toxicity of each whole text; an empty or null text has the bias alone."""
    out = np.full(len(column), model.bias)
    used = np.zeros(1 << BINS, bool)
    used[model.bins] = True
    for i, j, data, offsets in tb.blocks(column, tb.BLOCK_BYTES // 2):
        keys = [(owner[hit] << BINS) | bins[hit] for bins, owner in features(data, offsets) for hit in [used[bins]]]
        keys = np.unique(np.concatenate(keys))
        w = model.weights[np.searchsorted(model.bins, keys & ((1 << BINS) - 1))] if len(keys) else np.zeros(0)
        out[i:j] += np.bincount(keys >> BINS, w, minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, threshold: float = 0.3, train_bytes: int = labelled.TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic) for every row of ``docs``.

    Learns from at most ``train_rows`` labelled rows whose crc32(doc_id) mod 4 is not 2, and from at most ``train_bytes`` of their
    text (see :func:`.labelled.sample_frame`).  Null and empty texts score the
    bias; repeated rows score alike and are each returned; a null doc_id is not held out; more columns are ignored; no
    rows give no rows, and without labels every score is 0.5.
    """
    model = labelled.learned(Model, fit, docs, labels, "toxic", 4, 2, train_rows, train_bytes)
    return labelled.scored(docs, lambda column: score(model, column), 4, 2, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, threshold: float = 0.3, train_bytes: int = labelled.TRAIN_BYTES) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the learned model and the defined cases are :func:`toxicity`'s.

    Without labels nothing is known to be toxic, and all rows stay.
    """
    model = labelled.learned(Model, fit, docs, labels, "toxic", 4, 2, train_rows, train_bytes)
    if not len(model.bins) and not model.bias:
        return docs
    return labelled.kept(docs, lambda column: score(model, column), lambda s: s < threshold)
