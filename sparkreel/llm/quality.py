"""Quality: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes run over every byte of the text.  Their responses are max-pooled over
chunks of CHUNK bytes that overlap by half and together cover the whole text; each chunk's pooled, rectified vector counts
into the text's mean and maximum, which one logistic unit combines into a probability.  A filter is a table of one weight
for each byte value at each place; adjacent places are read as one pair, so a response costs WIDTH / 2 look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from . import textbytes as tb

WIDTH, FILTERS, CHUNK = 6, 8, 512
STEP = CHUNK // 2


@dataclass
class Model:
    """place (WIDTH, 256, FILTERS), bias (FILTERS,), out (2 * FILTERS,): mean then maximum, and out_bias."""

    place: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def _pad(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bytes, filled with zero bytes to whole steps, WIDTH - 1 bytes at least; and each text's first step.

    So every window that starts in a text ends among its own bytes.  The last WIDTH - 1 windows of its last step don't; they hold
    none of the text and are left out (:func:`_own`).
    """
    size = np.diff(offsets)
    steps = -(-(size + WIDTH - 1) // STEP)
    first = np.concatenate([[0], np.cumsum(steps)])
    out = np.zeros(first[-1] * STEP + WIDTH, np.uint8)
    shift = first[:-1] * STEP - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, first


def _responses(model_pairs: list[np.ndarray], data: np.ndarray) -> np.ndarray:
    """float32 (positions, FILTERS), without the bias."""
    n = len(data) - WIDTH
    pair = (data[:-1].astype(np.int32) << 8) | data[1:]
    out = np.take(model_pairs[0], pair[:n], axis=0)
    for k in range(1, WIDTH // 2):
        out += np.take(model_pairs[k], pair[2 * k : 2 * k + n], axis=0)
    return out


def _own(resp: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Responses (steps, STEP, FILTERS) without the windows that reach from the ``last`` step of a text into the next text."""
    resp[last, STEP - WIDTH + 1 :] = -np.inf
    return resp


def _step_maxima(pairs: list[np.ndarray], padded: np.ndarray, first: np.ndarray, steps: int = 1024) -> np.ndarray:
    """Maximal responses within each step, a bounded number of steps at a time."""
    total, last = first[-1], first[1:] - 1
    out = []
    for a in range(0, total, steps):
        b = min(total, a + steps)
        resp = _responses(pairs, padded[a * STEP : b * STEP + WIDTH]).reshape(-1, STEP, FILTERS)
        out.append(_own(resp, last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a).max(1))
    return np.concatenate(out)


def _pairs(place: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray((place[2 * k][:, None, :] + place[2 * k + 1][None, :, :]).reshape(65536, FILTERS), np.float32) for k in range(WIDTH // 2)]


def _chunks(step_max: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maxima over chunks of two adjacent steps of one text; a text's last step is followed by nothing."""
    out = step_max.copy()
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    at = np.flatnonzero(inner)
    out[at] = np.maximum(step_max[at], step_max[at + 1])
    return out


def _combine(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * FILTERS): mean and maximum over each text's chunks."""
    return np.concatenate([np.add.reduceat(chunks, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(chunks, first[:-1])], 1)


def _bounded(pick: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
    """Texts in groups of at most ``most`` bytes together, or of one."""
    upto = np.cumsum(sizes[pick])
    out, lo = [], 0
    while lo < len(pick):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        out.append(pick[lo:hi])
        lo = hi
    return out


def _gradients(params: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sums over the texts of the log-loss's gradients, through the positions that gave the maxima."""
    place, bias, out, out_bias = params
    padded, first = _pad(data, offsets)
    resp = _own(_responses(_pairs(place), padded).reshape(-1, STEP, FILTERS), first[1:] - 1)
    top = resp.argmax(1)
    best = np.take_along_axis(resp, top[:, None, :], 1)[:, 0, :] + bias
    pos = top + np.arange(len(top))[:, None] * STEP
    chunk = _chunks(best, first)
    inner = np.ones(len(best), bool)
    inner[first[1:] - 1] = False
    follow = np.arange(len(best)) + inner
    source = np.where(best >= best[follow], pos, pos[follow])
    act = np.maximum(chunk, 0)
    feats = _combine(act, first)
    g = 1 / (1 + np.exp(-np.clip(feats @ out + out_bias, -35, 35))) - y
    d_feat = g[:, None] * out
    count = np.diff(first)
    owner = np.repeat(np.arange(len(y)), count)
    is_max = act == feats[owner, FILTERS:]
    share_max = np.add.reduceat(is_max.astype(float), first[:-1])
    d_chunk = d_feat[owner, :FILTERS] / count[owner][:, None] + is_max * (d_feat[:, FILTERS:] / share_max)[owner]
    d_chunk *= chunk > 0
    d_place = np.zeros_like(place)
    f = np.broadcast_to(np.arange(FILTERS), source.shape)
    for w in range(WIDTH):
        np.add.at(d_place[w], (padded[source + w], f), d_chunk)
    return [d_place, d_chunk.sum(0), feats.T @ g, np.array([g.sum()])]


def fit(column: pa.Array, labels: list[int], passes: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam on the log-loss, a bounded number of bytes at a time.  No texts: every score is 0.5."""
    rng = np.random.default_rng(seed)
    place = rng.normal(0, 0.3, (WIDTH, 256, FILTERS))
    bias, out, out_bias = np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)
    if not labels:
        return Model(place, bias, out * 0, 0.0)
    data, offsets = tb.text_bytes(column)
    y = np.array(labels, float)
    share = np.clip(y.mean(), 0.02, 0.98)
    out_bias[0] = np.log(share / (1 - share))
    params = [place, bias, out, out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            grads = [1e-5 * place, np.zeros_like(bias), 1e-4 * out, np.zeros(1)]
            for pick in _bounded(order[lo : lo + batch], np.diff(offsets)):
                text = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in pick])
                parts = _gradients(params, text, np.concatenate([[0], np.cumsum(np.diff(offsets)[pick])]), y[pick])
                for whole, part in zip(grads, parts, strict=True):
                    whole += part / min(batch, len(order) - lo)
            t += 1
            for q, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(place, bias, out, float(out_bias[0]))


def score(model: Model, column: pa.Array, pairs: list[np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 of each whole text; an empty or null text is one chunk of zero bytes.

    A score depends on nothing but the text: not on the texts around it, nor on how many there are.
    """
    pairs = pairs or _pairs(model.place)
    out = np.zeros(len(column))
    for i, j, data, offsets in tb.blocks(column, 1 << 18):
        padded, first = _pad(data, offsets)
        best = _step_maxima(pairs, padded, first) + model.bias
        feats = _combine(np.maximum(_chunks(best, first), 0), first)
        out[i:j] = (feats * model.out).sum(1) + model.out_bias  # row by row: a matrix product's rounding depends on the rows' number
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _scorer(docs: DataFrame, labels: DataFrame, train_rows: int, train_bytes: int):
    """A function from a column of texts to probabilities, learned from the labels; it travels to the executors."""
    model = labelled.learned(Model, fit, docs, labels, "quality", 5, 0, train_rows, train_bytes)
    model.place = model.place.astype(np.float32)
    kept: list[list[np.ndarray]] = []  # tables of pairs, made once in each worker

    def run(column: pa.Array) -> np.ndarray:
        if not kept:
            kept.append(_pairs(model.place))
        return score(model, column, kept[0])

    return run


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, threshold: float = 0.3, train_bytes: int = labelled.TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) for every row of ``docs``.

    Learns from at most ``train_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0, and from at most ``train_bytes`` of their
    text (see :func:`.labelled.sample_frame`).  Null and empty texts are one
    blank chunk; repeated rows score alike and are each returned; a null doc_id is not held out; more columns are ignored;
    no rows give no rows, and without labels every score is 0.5.
    """
    return labelled.scored(docs, _scorer(docs, labels, train_rows, train_bytes), 5, 0, threshold)


def of_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, threshold: float = 0.3, train_bytes: int = labelled.TRAIN_BYTES) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; the learned model and the defined cases are :func:`quality`'s."""
    return labelled.kept(docs, _scorer(docs, labels, train_rows, train_bytes), lambda s: s >= threshold)
