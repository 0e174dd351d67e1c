"""Vectorised hashes of words and of word windows, for use inside tasks.

Texts are handled as UTF-8 bytes, many at a time. A polynomial prefix sum modulo 2^64 gives the hash of any stretch of
bytes by one subtraction and one multiplication; a second prefix sum over word hashes does the same for windows.
"""

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BYTE_STEP, _WORD_STEPS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_VALUES = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are joined up to this many bytes, longer ones stand alone.
CHUNK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step^k and step^-k modulo 2^64 for k below n."""
    if step not in _powers or len(_powers[step][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for x in (step, pow(step, -1, 1 << 64)):
            a = np.full(size, U(x))
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[step] = both[0], both[1]
    up, down = _powers[step]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix(values: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(step, len(values))[0], out=out[1:])
    return out


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(buf) + 2, dtype=bool)
    gap[1:-1] = SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix(_VALUES[buf], _BYTE_STEP)
    return mix((sums[ends] - sums[starts]) * powers(_BYTE_STEP, len(buf) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of the n words from each position on that has as many; which picks one of two independent hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix(words, _WORD_STEPS[which])
    return mix((sums[n:] - sums[:-n]) * powers(_WORD_STEPS[which], len(words))[1][: len(words) - n + 1])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, its joined bytes, where each text starts in them) for runs of texts."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]) + 1, at + 1
        while end < len(texts) and size + len(texts[end]) < CHUNK:
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        offsets = np.zeros(len(part), dtype=np.int64)
        np.cumsum([len(x) + 1 for x in part[:-1]], out=offsets[1:])
        yield at, np.frombuffer(b"\n".join(part), dtype=np.uint8), offsets
        at = end


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in order, and for each word the index of its text."""
    words, owners = [], []
    for at, buf, offsets in chunks(texts):
        starts, ends = word_bounds(buf)
        words.append(word_hashes(buf, starts, ends))
        owners.append(at + np.searchsorted(offsets, starts, side="right") - 1)
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(words), np.concatenate(owners)
