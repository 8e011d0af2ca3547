"""Vectorised hashing of words and byte windows (numpy, inside Spark tasks).

All hashes derive from one polynomial over bytes modulo 2**64 with an odd
base: prefix sums give the hash of any stretch after a shift by the inverse
power, so a batch of texts is hashed without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# White space bytes of the word definition.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15  # odd
MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once (a longer text is its own chunk).
CHUNK = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept between calls)."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**position before each position (uint64 values)."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) behind prefix sums."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` positions."""
    n = len(sums) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = powers(len(sums))[1]
    return mix((sums[width:] - sums[:n]) * inverse[:n])


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the offsets of each text's words
    (one more than texts). ``lower`` folds A-Z."""
    raw = b"\n" + b"\n".join(texts) + b"\n"
    b = np.frombuffer(raw, np.uint8)
    space = _is_space[b]
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    v = b.astype(np.uint64)
    if lower:
        v = v + np.uint64(32) * ((b >= 65) & (b <= 90)).astype(np.uint64)
    h = stretches(prefix_sums(v), start, end)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, bounds + 1)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in every window of ``width`` (the leftmost
    of equals, after the low bits of the values gave way to the position)."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    span, out = 1, n - width + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[:out], m[width - span:width - span + out])
    return (m & low).astype(np.int64)


def anchors(sums: np.ndarray, width: int, k: int, block: int | None = None):
    """Partition of the starts of all windows of ``width`` positions by their
    minimal ``k``-window (and, in blocks, by the distance to it).

    Equal windows hold the same least k-window at the same distance, wherever
    they are, so they fall into parts that agree in both. Returns (anchor,
    first start, last start) arrays.
    """
    at = sliding_argmin(windows(sums, k), width - k + 1)
    if not len(at):
        return at, at, at
    cut = np.diff(at) != 0
    if block:
        far = (at - np.arange(len(at))) // block
        cut |= np.diff(far) != 0
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last
