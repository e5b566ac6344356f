"""Words of whole text batches as numpy arrays.

A word is a longest run of bytes other than space and the control characters 9 to 13.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = (~_SPACE).astype(np.uint8)
#: Kinds of bytes: letters and digits 1, other visible characters 2.
LETTERS_AND_MARKS = np.where(_SPACE, 0, 2).astype(np.uint8)
LETTERS_AND_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LETTERS = np.where(LETTERS_AND_MARKS == 1, 1, 0).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base modulo 2^64."""
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 64), _BASE, np.uint64)
        steps[0] = 1
        _power = np.cumprod(steps)
    return _power[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def solid_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_SPACE[data]


def split_runs(
    data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, single: int = -1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes of one kind other than 0 (``kinds`` has the kind of each byte), and
    the row of ``bounds`` (offsets of texts) it lies in.  Runs never cross texts; bytes of kind ``single`` stand alone."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = kinds[data]
    edge = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[edge] = True
    if single >= 0:
        alone = np.flatnonzero(kind == single)
        change[alone] = True
    cut = np.flatnonzero(change)
    full = kind[cut[:-1]] != 0
    starts, ends = cut[:-1][full], cut[1:][full]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    return split_runs(data, bounds, _WORD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.cumsum(size) - size
    within = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
    solid = data[within + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(solid * powers(int(size.max()))[within], at) + size.astype(np.uint64))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive entries (shorter by n - 1)."""
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = mix(out * _BASE + hashes[k : len(hashes) - n + 1 + k])
    return out
