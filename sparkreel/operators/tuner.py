"""Distribution tuner: from classes of sampled rounds to one weighted seed bank with a wanted mean and deviation.

Candidates are drawn many at a time in numpy.  Collection runs on the cluster (see ``tags.collect_strata``); a class then has a
fixed, small number of samples, and the search over shapes of those is a driver task, or ``mapInArrow`` over shape ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from .sampling import alias_table

# Hit probabilities are parts of a million; weights are cut to 52 bits; limits of the searches.
BASE = 1_000_000
ACCURACY = 1 << 52
MOST_TRIES, RETRIES, MERCY = 100_000, 500, 100
#: Samples of a class, at most: they meet in one task and then in the driver.
MOST_SAMPLES = 5_000_000


class TunerError(EngineError):
    """A setting that breaks a rule, or a search that found nothing."""


@dataclass(frozen=True)
class Mixture:
    """Ranges of a random mixture."""

    method: str = "gaussian"
    k_range: tuple[int, int] = (1, 1)
    mu_center: float = 0.0
    mu_std: float = 1.0
    std_range: tuple[float, float] = (1.0, 1.0)
    amp_range: tuple[float, float] = (1.0, 1.0)
    zero_range: tuple[float, float] = (0.0, 0.0)
    spike_mass: tuple[float, float] | None = None
    spike_wins: tuple[float, float] = (0.0, 0.0)
    biases: tuple[tuple[float, float, int], ...] = ()


@dataclass(frozen=True)
class ClassSetting:
    name: str
    tags: tuple[str, ...]
    min_win: float
    max_win: float
    collect: int
    hit_prob: int
    exp_win: float
    basis: int
    shapes: int
    mixture: Mixture
    ratio: tuple[float, float]


def parse_settings(raw: Mapping[str, Any]) -> tuple[float, list[ClassSetting]]:
    """(target deviation, classes) of a tuner configuration; a class of probability 0 takes what is left of a million."""
    target = raw.get("target_std", raw.get("trget_std"))
    if target is None:
        raise TunerError("a target deviation is needed")
    out = []
    for c in raw.get("class_settings") or ():
        shape = c.get("shape_cfg") or {}
        method = shape.get("method", "uniform")
        cfg = shape.get(method) or {}
        spike = cfg.get("spike") or {}
        quality = c.get("quality_evaluate")
        if not quality:
            raise TunerError(f"class {c.get('class_name')}: quality_evaluate is needed")
        mass = spike.get("mass_range")
        mixture = Mixture(
            method,
            tuple(cfg.get("k_range") or (1, 1)),
            float(cfg.get("mu_center", 0)),
            float(cfg.get("mu_std", 1)),
            tuple(cfg.get("std_range") or (1, 1)),
            tuple(cfg.get("amp_range") or (1, 1)),
            tuple(cfg.get("zero_range") or (0, 0)),
            tuple(mass) if mass else None,
            tuple(spike.get("win_range") or (0, 0)),
            tuple((*b["range"], int(b["prob"])) for b in cfg.get("biases") or ()),
        )
        out.append(ClassSetting(c["class_name"], tuple(c.get("match_tags") or ()), float(c["min_win"]), float(c["max_win"]), int(c["collect"]), int(c.get("hit_prob", 0)), float(c["exp_win"]), int(c["basis"]), int(c["shapes_collect"]), mixture, tuple(quality["mean_median_ratio"])))
    for c in out:
        _check(c)
    return float(target), share_out(out)


def _check(c: ClassSetting) -> None:
    m = c.mixture
    if m.method not in SHAPES:
        raise TunerError(f"class {c.name}: no shape method {m.method!r}")
    ok = [0 < c.collect <= MOST_SAMPLES, c.basis > 0, c.shapes > 0, c.min_win <= c.max_win, c.ratio[0] <= c.ratio[1]]
    if m.method != "uniform":
        ok += [c.min_win <= m.mu_center <= c.max_win, 1 <= m.k_range[0] <= m.k_range[1], m.std_range[0] <= m.std_range[1], m.amp_range[0] <= m.amp_range[1], 0 <= m.zero_range[0] <= m.zero_range[1] <= 1]
        ok += [c.min_win <= lo <= hi <= c.max_win for lo, hi, _ in m.biases] + [sum(p for *_, p in m.biases) <= BASE]
        if m.spike_mass:
            ok += [0 <= m.spike_mass[0] <= m.spike_mass[1], m.spike_mass[1] + m.zero_range[1] <= 1, m.spike_wins[0] <= m.spike_wins[1]]
    if not all(ok):
        raise TunerError(f"class {c.name}: a range is out of order or out of bounds")


def share_out(classes: Sequence[ClassSetting]) -> list[ClassSetting]:
    rest = [c for c in classes if c.hit_prob == 0]
    left = BASE - sum(c.hit_prob for c in classes)
    if len(rest) > 1 or left < 0 or (left and not rest) or not classes:
        raise TunerError("hit probabilities must sum to a million, with one remainder class at most")
    return [replace(c, hit_prob=left) if c.hit_prob == 0 else c for c in classes]


def normal_pdf(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def gamma_pdf(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Gamma density with this mean; the shape parameter is at least 1.2."""
    from math import lgamma

    alpha = np.maximum(1.2, (mu / sd) ** 2)
    beta = alpha / mu
    log_gamma = np.vectorize(lgamma)(alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.exp(alpha * np.log(beta) + (alpha - 1) * np.log(x) - beta * x - log_gamma)
    return np.where(x > 0, out, 0.0)


def _mixture(pdf: Callable, c: ClassSetting, wins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    m, weights = c.mixture, np.zeros(len(wins))
    zeros = int(np.searchsorted(wins, 0.0, "right"))
    zero_mass = rng.uniform(*m.zero_range) if zeros and m.zero_range[1] > 0 else 0.0
    weights[:zeros] = zero_mass / max(zeros, 1)
    spike, at = 0.0, None
    if m.spike_mass:
        inside = np.flatnonzero((wins >= m.spike_wins[0]) & (wins <= m.spike_wins[1]) & (wins > 0))
        if len(inside):
            spike, at = rng.uniform(*m.spike_mass), int(rng.choice(inside))
    remain = 1.0 - zero_mass - spike
    if remain > 1e-12:
        if zeros == len(wins):
            raise TunerError(f"class {c.name}: no win above zero can take the mixture's mass")
        probs = np.array([*(p for *_, p in m.biases), BASE - sum(p for *_, p in m.biases)], float) / BASE
        for _ in range(RETRIES):
            k = int(rng.integers(m.k_range[0], m.k_range[1] + 1))
            kind = rng.choice(len(probs), k, p=probs)
            center = np.array([rng.uniform(*m.biases[i][:2]) if i < len(m.biases) else m.mu_center for i in kind])
            mu = center + rng.standard_normal(k) * m.mu_std
            for _ in range(MOST_TRIES):
                bad = (mu < c.min_win) | (mu > c.max_win)
                if not bad.any():
                    break
                mu[bad] = center[bad] + rng.standard_normal(bad.sum()) * m.mu_std
            else:
                raise TunerError(f"class {c.name}: no centre of a mixture falls between its wins")
            sd = np.maximum(1e-9, rng.uniform(*m.std_range, k))
            amp = rng.uniform(*m.amp_range, k)
            amp[amp <= 0] = 1e-9
            own = (amp * pdf(wins[zeros:, None], mu, sd)).sum(1)
            if np.isfinite(own.sum()) and own.sum() > 0:
                weights[zeros:] = own * (remain / own.sum())
                break
        else:
            raise TunerError(f"class {c.name}: {RETRIES} mixtures had no mass on its wins")
    if at is not None:
        weights[at] += spike
    return weights


Generator = Callable[[ClassSetting, np.ndarray, np.random.Generator], np.ndarray]
SHAPES: dict[str, Generator] = {
    "gaussian": lambda c, wins, rng: _mixture(normal_pdf, c, wins, rng),
    "gamma": lambda c, wins, rng: _mixture(gamma_pdf, c, wins, rng),
    "uniform": lambda c, wins, rng: np.full(len(wins), 1.0 / len(wins)),
}


def mean_of(wins: np.ndarray, weights: np.ndarray) -> float:
    return float(wins @ weights)


def median_of(wins: np.ndarray, weights: np.ndarray) -> float:
    """The first of the sorted wins at which the weights reach a half of their sum; the last one if rounding keeps them under it."""
    at = int(np.searchsorted(np.cumsum(weights), 0.5 * np.sum(weights)))
    return float(wins[min(at, len(wins) - 1)]) if len(wins) else 0.0


def population_std(wins: np.ndarray, weights: np.ndarray) -> float:
    mean = (wins * weights).sum() / weights.sum()
    return float(np.sqrt((weights * (wins - mean) ** 2).sum() / weights.sum()))


def make_basis(c: ClassSetting, wins: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(shapes with a mean of at least the target, shapes of at most it), ``basis`` of each."""
    high, low = [], []
    for _ in range(MOST_TRIES):
        if len(high) >= c.basis and len(low) >= c.basis:
            return high, low
        w = SHAPES[c.mixture.method](c, wins, rng)
        mean = mean_of(wins, w)
        if mean >= c.exp_win and len(high) < c.basis:
            high.append(w)
        if mean <= c.exp_win and len(low) < c.basis:
            low.append(w)
    raise TunerError(f"class {c.name}: shapes don't reach both sides of a mean of {c.exp_win}")


def blend(wins: np.ndarray, high: np.ndarray, low: np.ndarray, target: float) -> np.ndarray | None:
    """The mix of two shapes whose mean is the target; None if it lies outside them."""
    a, b = mean_of(wins, high), mean_of(wins, low)
    if a == b:
        return high
    if a < b:
        high, low, a, b = low, high, b, a
    p = (target - b) / (a - b)
    return p * high + (1 - p) * low if 0 <= p <= 1 else None


@dataclass
class RatioFilter:
    """Accepts shapes whose mean to median ratio is inside a range; it widens by 0.2 with each failure from the MERCY-th in a row."""

    lo: float
    hi: float
    fails: int = 0

    def __call__(self, mean: float, median: float) -> bool:
        if median <= 0 and mean <= 0:
            return self.lo <= 1 <= self.hi
        ratio = mean / (median if median > 0 else 1e-6)
        if self.lo < ratio < self.hi:
            self.fails = 0
            return True
        self.fails += 1
        if self.fails >= MERCY:
            self.lo, self.hi = self.lo - 0.2, self.hi + 0.2
        return False


@dataclass
class TunedClass:
    setting: ClassSetting
    wins: np.ndarray
    snaps: list[bytes]
    shapes: list[np.ndarray] = field(default_factory=list)


def fit_class(c: ClassSetting, wins: np.ndarray, snaps: list[bytes], rng: np.random.Generator, accept: Callable[[float, float], bool] | None = None) -> TunedClass:
    """``shapes`` blends with the class's mean that the filter accepts; wins are sorted with their snapshots."""
    order = np.argsort(wins, kind="stable")
    out = TunedClass(c, wins[order], [snaps[i] for i in order])
    accept = accept or RatioFilter(*c.ratio)
    high, low = make_basis(c, out.wins, rng)
    for _ in range(MOST_TRIES):
        if len(out.shapes) == c.shapes:
            return out
        w = blend(out.wins, high[rng.integers(len(high))], low[rng.integers(len(low))], c.exp_win)
        if w is not None and accept(mean_of(out.wins, w), median_of(out.wins, w)):
            out.shapes.append(w)
    raise TunerError(f"class {c.name}: too few shapes pass the filter")


def deviation_fitness(target: float) -> Callable[[int, np.ndarray, np.ndarray], bool]:
    """Accepts a deviation near the target; the tolerance grows by a tenth with every hundred rounds."""
    return lambda n, wins, weights: abs(population_std(wins, weights) - target) < 0.1 * (1 + n // 100) * target


def screen(classes: Sequence[TunedClass], accept: Callable[[int, np.ndarray, np.ndarray], bool], rng: np.random.Generator) -> np.ndarray:
    """Weights over all classes' samples, of the first random choice of one shape a class that is accepted."""
    wins = np.concatenate([c.wins for c in classes])
    for n in range(1, MOST_TRIES + 1):
        weights = np.concatenate([c.shapes[rng.integers(len(c.shapes))] * (c.setting.hit_prob / BASE) for c in classes])
        if accept(n, wins, weights):
            return weights
    raise TunerError("no choice of shapes has the wanted deviation")


def quantize(weights: Sequence[float]) -> np.ndarray:
    """Whole weights: parts of 2**52 / n, rounded down; all 1 where nothing is positive."""
    w = np.maximum(np.asarray(weights, float), 0)
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    base = max(1, ACCURACY // n)
    out = np.floor(w / w.sum() * base).astype(np.int64) if w.sum() > 0 else np.zeros(n, np.int64)
    return out if out.any() else np.ones(n, np.int64)


@dataclass(frozen=True)
class SeedBank:
    """An alias table over samples, and their snapshots of one length end to end."""

    prob: np.ndarray
    alias: np.ndarray
    total: int
    seed_len: int
    seeds: bytes

    def validate(self) -> None:
        if not len(self.prob) or self.seed_len <= 0 or len(self.seeds) != self.seed_len * len(self.prob):
            raise TunerError("a seed bank needs a table and one seed for each slot")

    def seed(self, i: int) -> bytes:
        return self.seeds[i * self.seed_len : (i + 1) * self.seed_len]


def tune(classes: Sequence[tuple[ClassSetting, np.ndarray, list[bytes]]], target_std: float, seed: int = 1) -> tuple[SeedBank, np.ndarray, np.ndarray]:
    """(bank, wins, weights) from the collected samples of each class."""
    rng = np.random.default_rng(seed)
    fitted = [fit_class(c, np.asarray(w, float), s, rng) for c, w, s in classes]
    weights = screen(fitted, deviation_fitness(target_std), rng)
    prob, alias, total = alias_table(quantize(weights).tolist())
    snaps = [s for c in fitted for s in c.snaps]
    bank = SeedBank(prob, alias, total, len(snaps[0]), b"".join(snaps))
    bank.validate()
    return bank, np.concatenate([c.wins for c in fitted]), weights


def save(bank: SeedBank, game_id: int, folder: str | Path, info: Mapping[str, Any] | None = None) -> None:
    """Artifacts under fixed names: compressed JSON, seeds, probabilities (u64 LE), aliases (u32 LE) and a summary."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    picker = {"prob": bank.prob.tolist(), "aliases": bank.alias.tolist(), "size": len(bank.prob), "total": bank.total}
    (at / f"gacha_{game_id}.json.zst").write_bytes(zstandard.compress(json.dumps({"picker": picker, "seed_len": bank.seed_len}).encode()))
    (at / f"seed_bank_{game_id}.bin").write_bytes(bank.seeds)
    (at / f"prob_{game_id}.bin").write_bytes(bank.prob.astype("<u8").tobytes())
    (at / f"aliases_{game_id}.bin").write_bytes(bank.alias.astype("<u4").tobytes())
    (at / f"info_{game_id}.json").write_text(json.dumps(dict(info or {}) | {"size": len(bank.prob), "seed_len": bank.seed_len}))


def load_bank(game_id: int, folder: str | Path) -> SeedBank:
    at = Path(folder)
    raw = json.loads(zstandard.decompress((at / f"gacha_{game_id}.json.zst").read_bytes()))
    p = raw["picker"]
    bank = SeedBank(np.array(p["prob"]), np.array(p["aliases"]), p["total"], raw["seed_len"], (at / f"seed_bank_{game_id}.bin").read_bytes())
    bank.validate()
    return bank


def shapes_frame(spark: SparkSession, c: ClassSetting, wins: Sequence[float], n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """(shape_id, weights, mean, median) of ``n`` random shapes, each from its own seed, on the executors."""
    own = np.sort(np.asarray(wins, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [SHAPES[c.mixture.method](c, own, np.random.default_rng([seed, i])) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tolist() for w in made], pa.list_(pa.float64())), pa.array([mean_of(own, w) for w in made], pa.float64()), pa.array([median_of(own, w) for w in made], pa.float64())], names=["shape_id", "weights", "mean", "median"])

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "shape_id").mapInArrow(run, "shape_id long, weights array<double>, mean double, median double")


def load_bundle(units: Sequence[int], files: Sequence[int], folder: str | Path) -> dict[int, SeedBank]:
    """A bank for each bet unit; there must be as many."""
    if len(units) != len(files):
        raise TunerError("one bank for each bet unit is needed")
    return {u: load_bank(f, folder) for u, f in zip(units, files, strict=True)}
