"""64-bit hashes of all words of a batch of texts, without a loop over words.

A word is a run of bytes of one class. Both word definitions in use treat every
non-ASCII byte as part of a word, so a run of UTF-8 bytes is the run of
characters. ``A-Z`` hash as ``a-z``.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Powers that stay in a worker; longer texts make their own.
_KEPT = 1 << 19
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

#: Words are anything between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(32))
        x = x * _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INV):
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if n <= _KEPT:
        _powers[:] = made
    return made[0], made[1]


def hash_words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    ends_of_texts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = kind[buf].view(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    power, inverse = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    return words, counts


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words, one for each start; texts are not told apart."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= _U(0xC2B2AE3D27D4EB4F)
            out += words[k : k + m]
    return mix(out)
