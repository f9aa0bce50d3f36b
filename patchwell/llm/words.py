"""Vectorised words, shingles and their 64-bit hashes.

Words are maximal runs of word bytes in UTF-8 text whose A-Z are lowered. Each
hash is a position-free polynomial over random byte values modulo 2**64, mixed
with the word's length; two different words share one with probability about
2**-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of everything but white space (0x20 and 0x09-0x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _BLOCK
    while size < n:
        size *= 2
    if size not in _powers:
        if size > _BLOCK:
            _powers.clear()
        inv = pow(_P, -1, 1 << 64)
        both = []
        for base in (_P, inv):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def word_hashes(texts, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first index in them (one more than texts).

    A text that is null has no words. Work goes over blocks of about a megabyte
    that end between words, so one very long text needs no more memory a block.
    """
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    parts, where, at = [], [], 0
    while at < len(buf):
        end = min(at + _BLOCK, len(buf))
        while end < len(buf):
            seen = np.flatnonzero(~is_word[LOWER[buf[at:end]]])
            if len(seen):
                end = at + int(seen[-1]) + 1
                break
            end = min(len(buf), end + _BLOCK)
        low = LOWER[buf[at:end]]
        inside = is_word[low]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _power(len(low))
            run = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(_BYTES[low] * up[: len(low)], out=run[1:])
            parts.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
            where.append(s + at)
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    pos = np.concatenate(where)
    return np.concatenate(parts), np.searchsorted(pos, begins).astype(np.int64)


_TURN = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingle_sets(texts, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct ``width``-word shingles as sorted hashes; with fewer words, all of them as one."""
    h, first = word_hashes(texts, SPACED)
    if len(h) >= width:
        grams = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            grams += h[k : len(h) - width + 1 + k] * _TURN[k]
        grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < width:
            one = _U(n)
            for k in range(n):
                one = one + h[a + k : a + k + 1] * _TURN[k + 8]
            out.append(mix(np.atleast_1d(one)))
        else:
            out.append(np.unique(grams[a : b - width + 1]))
    return out
