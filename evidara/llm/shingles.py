"""Vectorised hashes of words, windows and sets of them, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M = 1 << 64
_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, _M)
_PIECE = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_K: np.ones(1, np.uint64), _K_INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), _M))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at blanks into pieces of about 1 MB, so that the work arrays stay small."""
    at = 0
    while len(data) - at > _PIECE:
        block = data[at : at + _PIECE]
        end = max(block.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        while not end:  # one word longer than a piece
            block = data[at : at + 2 * len(block)]
            end = max(block.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1 or (len(block) if at + len(block) >= len(data) else 0)
        yield data[at : at + end]
        at += end
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of anything but ASCII white space."""
    return np.concatenate([_hash_piece(x) for x in _pieces(data)])


def _hash_piece(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(_BLANK[b].view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_K, len(b)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_K_INVERSE, len(b))[start])


def window_hashes(h: np.ndarray, k: int, base: int = _K) -> np.ndarray:
    """A hash of each k consecutive values, by doubling; none if there are fewer than k."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, have, part, width = None, 0, h, 1
    while True:
        if k & width:
            out = part if out is None else out[: len(out) - width] * np.uint64(pow(base, width, _M)) + part[have : have + len(out) - width]
            have += width
        if have == k:
            return mix(out[: len(h) - k + 1])
        part = part[: len(part) - width] * np.uint64(pow(base, width, _M)) + part[width:]
        width *= 2


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = np.minimum(a[:-n], a[n:]), 2 * n
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the size-word shingles; fewer words make one shingle, none make none."""
    h = word_hashes(data)
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else h
