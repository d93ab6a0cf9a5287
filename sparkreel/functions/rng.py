"""Counter-based random numbers: a draw is a function of (seed, spin, draw number), so results don't depend on partitioning,
and (seed, spin) is all it takes to replay a spin."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np

U64 = np.uint64
# The public splitmix64 constants.
GOLDEN, M1, M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> U64(30))) * M1
        x = (x ^ (x >> U64(27))) * M2
        return x ^ (x >> U64(31))


def streams(seed: int | np.ndarray, spin_ids: np.ndarray) -> np.ndarray:
    """A state for each spin, of one seed or of a seed for each."""
    key = splitmix(seed.astype(np.int64).view(U64) if isinstance(seed, np.ndarray) else np.array([seed & (2**64 - 1)], U64))
    return splitmix(spin_ids.astype(np.int64).view(U64) ^ key)


def _splitmix_draw(state: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(state + np.asarray(number).astype(U64) * U64(0xD1B54A32D192ED03))


def _pcg_draw(state: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """PCG RXS M XS 64: the congruential sequence from ``state``, jumped ahead by the draw's number, and permuted."""
    number = np.asarray(number).astype(U64)
    scale, shift = U64(6364136223846793005), U64(1442695040888963407)
    with np.errstate(over="ignore"):
        add, mult = np.zeros_like(number), np.ones_like(number)
        left = number + U64(1)
        while left.any():
            odd = (left & U64(1)).astype(bool)
            mult, add = np.where(odd, mult * scale, mult), np.where(odd, add * scale + shift, add)
            shift, scale, left = (scale + U64(1)) * shift, scale * scale, left >> U64(1)
        x = state * mult + add
        x = ((x >> ((x >> U64(59)) + U64(5))) ^ x) * U64(12605985483714917081)
        return x ^ (x >> U64(43))


#: Generators by name: 64 bits as a function of (state, draw number), so that every draw can be made alone.
GENERATORS: dict[str, Callable[[np.ndarray, int | np.ndarray], np.ndarray]] = {"splitmix": _splitmix_draw, "pcg64": _pcg_draw}
_in_use = ["splitmix"]


def register_generator(name: str, draw_bits: Callable[[np.ndarray, int | np.ndarray], np.ndarray]) -> None:
    """Add a generator; a name can be registered once."""
    if name in GENERATORS:
        raise ValueError(f"there is a generator {name}")
    GENERATORS[name] = draw_bits


@contextlib.contextmanager
def using(name: str) -> Iterator[None]:
    """Draws inside come from this generator."""
    if name not in GENERATORS:
        raise ValueError(f"no generator {name}")
    _in_use.append(name)
    try:
        yield
    finally:
        _in_use.pop()


def draw(state: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """64 random bits for a draw number of each stream."""
    return GENERATORS[_in_use[-1]](state, number)


def _product(bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 64 bits of bits * n."""
    mask, s = U64(0xFFFFFFFF), U64(32)
    with np.errstate(over="ignore"):
        b1, b0, n1, n0 = bits >> s, bits & mask, n >> s, n & mask
        low = b0 * n0
        mid = b1 * n0 + (low >> s)
        mid2 = b0 * n1 + (mid & mask)
        return b1 * n1 + (mid >> s) + (mid2 >> s), bits * n


def below(bits: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """0..n-1, each exactly as likely, by multiply-high; -1 where n is 0 or less.

    The few bits that would make some numbers likelier are refused, and mixed again until they aren't.
    """
    n = np.broadcast_to(np.asarray(n, np.int64), bits.shape)
    size = np.maximum(n, 1).astype(U64)
    high, low = _product(bits, size)
    if (low < size).any():
        with np.errstate(over="ignore"):
            least = (U64(0) - size) % size  # 2**64 modulo n
        while (bad := low < least).any():
            bits = np.where(bad, splitmix(bits), bits)
            high, low = _product(bits, size)
    return np.where(n > 0, high.astype(np.int64), -1)


def pick(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value for each draw; -1 where there are none."""
    return values[below(bits, len(values))] if len(values) else np.full(len(bits), -1)


def shuffled(state: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """(streams, n): a permutation of 0..n-1 for each stream, by exchanges from the end, from draw ``first`` on."""
    out = np.tile(np.arange(n), (len(state), 1))
    rows = np.arange(len(state))
    for i in range(n - 1, 0, -1):
        j = below(draw(state, first + n - 1 - i), i + 1)
        out[rows, i], out[rows, j] = out[rows, j], out[rows, i].copy()
    return out


def unit(bits: np.ndarray) -> np.ndarray:
    """[0, 1) on 53 bits."""
    return (bits >> U64(11)).astype(np.float64) * 2.0**-53


def exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log1p(-unit(bits))


def normal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Box-Muller from two draws."""
    return np.sqrt(2 * exponential(a)) * np.cos(2 * np.pi * unit(b))


def seed_stream(seed: int, n: int) -> list[int]:
    """n seeds for machines, from a 63-bit congruential sequence, each mixed."""
    mask, out = (1 << 63) - 1, []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & mask
        x = seed
        x = ((x ^ (x >> 30)) * int(M1)) & mask
        x = ((x ^ (x >> 27)) * int(M2)) & mask
        out.append(x ^ (x >> 31))
    return out
