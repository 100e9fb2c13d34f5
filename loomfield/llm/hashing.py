"""Polynomial hashes of all substrings of a byte string or of a run of code points, modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.empty(0, np.uint64)
_INVERSES = np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS, _INVERSES = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWERS[:n], _INVERSES[:n]


#: A random-looking odd word for every byte value.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A3564E27F88695)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H, one longer than data (bytes); substring_hashes() takes it."""
    return _summed(_BYTES[data])


def _summed(values: np.ndarray) -> np.ndarray:
    power, _ = _tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], dtype=np.uint64, out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """h with every bit depending on all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def substring_hashes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of data[a:b], element by element; equal strings have equal hashes wherever they are."""
    _, inverse = _tables(len(prefix))
    return mixed((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))


def deletion_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of points[starts[k]:ends[k]] (code points), each of them whole and without each one of its
    points, and k for each: equal strings have equal hashes. Of neighbours that are equal one is left out,
    as all give the same string. Takes time in proportion to the points, however long a string is."""
    prefix = _summed(mixed(points.astype(np.uint64) + np.uint64(1)))
    _, inverse = _tables(len(prefix))
    size = ends - starts
    owner = np.repeat(np.arange(len(starts)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[owner]
    same = np.zeros(len(points) + 1, bool)
    same[1:-1] = points[1:] == points[:-1]
    keep = ~same[at] | (at == starts[owner])
    owner, at = owner[keep], at[keep]
    a, b = starts[owner], ends[owner]
    left = (prefix[at] - prefix[a]) * inverse[a] + (prefix[b] - prefix[at + 1]) * inverse[a + 1]
    less = mixed(left + (b - a - 1).astype(np.uint64))
    whole = substring_hashes(prefix, starts, ends)
    return np.concatenate([np.arange(len(starts)), owner]), np.concatenate([whole, less])
