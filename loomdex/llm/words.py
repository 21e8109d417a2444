"""Words, windows and shingles of whole texts, hashed in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 text is exactly the pattern
``[^\\x20\\x09-\\x0D]+``. A null text counts as the empty text and has no words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes hashed at once; buffers are cut at white space, so that only a longer single word exceeds it.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, CHUNK + 4096), _P, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _chunk(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # sum over the word of table[byte] * P^(distance to the word's end): equal words have equal sums anywhere
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _powers(n), out=total[1:])
    h = (total[end] - total[start]) * _inverse_powers(n)[start]
    return mix(h), start, end


_INVERSE = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        grown = np.full(max(n, CHUNK + 4096), np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)
        grown[0] = 1
        _INVERSE = np.multiply.accumulate(grown)
    return _INVERSE[:n]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and offsets: words of text i are [offsets[i], offsets[i + 1])."""
    raw = [t.encode() if t else b"" for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        to = min(at + CHUNK, len(buf))
        if to < len(buf):
            back = np.flatnonzero(_SPACE[buf[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                step = to
                while step < len(buf) and not _SPACE[buf[step]]:
                    step += 1 if len(buf) - step < 64 else int(np.argmax(np.append(_SPACE[buf[step : step + CHUNK]], True)))
                to = min(step + 1, len(buf))
        h, s, _ = _chunk(buf[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, begins)


def windows(h: np.ndarray, offsets: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k lie in one text. Both as long as h."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(h), np.uint64)
    # with fewer than k words in all no window is whole, and none reaches past the end
    for i in range(min(k, len(h))):
        m = rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
        out[: len(h) - i] += h[i:] * m
    whole = np.zeros(len(h) + 1, np.int32)
    counts = np.diff(offsets)
    lo, hi = offsets[:-1][counts >= k], offsets[1:][counts >= k] - k + 1
    np.add.at(whole, lo, 1)
    np.add.at(whole, hi, -1)
    return mix(out), np.cumsum(whole)[:-1].astype(bool)
