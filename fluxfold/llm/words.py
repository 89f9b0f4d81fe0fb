"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_UPPER = {b: b + 32 for b in range(65, 91)}


def _table(separators: bytes) -> bytes:
    """Byte map that lower-cases A-Z and turns every separator into a space."""
    return bytes(0x20 if b in separators else _UPPER.get(b, b) for b in range(256))


#: Words are runs of anything but ASCII white space.
BY_SPACE = _table(_SPACE_BYTES)
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = _table(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
)

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 19), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    hashes: np.ndarray
    #: Words of text i are hashes[bounds[i]:bounds[i + 1]].
    bounds: np.ndarray


def hash_words(texts: list[str | None], table: bytes) -> Words:
    """Hashes of the words of every text; a null text has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    blob = np.frombuffer((b" ".join(raw) + b" ").translate(table), np.uint8)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    inside = np.empty(len(blob) + 1, bool)
    inside[0] = False
    np.not_equal(blob, 0x20, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(blob) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[blob] * _powers(_FACTOR, len(blob)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(blob))[starts])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return Words(hashes, bounds)


_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at ``offsets`` from every start, over one array of words."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, offset in enumerate(offsets):
        total += hashes[offset : offset + n] * _WEIGHTS[k]
    return mix(total)
