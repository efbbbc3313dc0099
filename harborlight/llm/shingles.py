"""Sets of five-word shingles of whole texts, as sorted 64-bit hashes, computed over many texts at a time."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
_WHITE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_IS_WHITE = np.isin(np.arange(256), list(_WHITE))
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.ones(size, dtype=np.uint64), np.ones(size, dtype=np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased A-Z, and where each text's words begin (with a last entry for the end)."""
    joined = b" ".join(texts).translate(_LOWER) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    white = _IS_WHITE[data]
    before = np.concatenate(([True], white[:-1]))
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    up, down = _powers(1 << max(20, len(data).bit_length()))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    hashes = mixed((running[ends] - running[starts]) * down[starts])
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than a shingle make one, no words none."""
    hashes, bounds = word_hashes([(t or "").encode() for t in texts])
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, n)):
            rolled[: n - k] += hashes[k:] * _STEP ** np.uint64(k)
        rolled = mixed(rolled)
        out = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                short = (hashes[a:b] * _STEP ** np.arange(b - a, dtype=np.uint64)).sum(dtype=np.uint64)
                out.append(mixed(np.array([short ^ np.uint64(b - a)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
