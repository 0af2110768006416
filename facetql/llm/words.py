"""Words and word shingles of a batch of texts, as 64-bit hashes computed on whole byte buffers.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; the hash of a word is a
polynomial over a random value per byte, mixed at the end.  Words over ``LONG`` bytes are hashed by BLAKE2 instead:
modulo 2**64 all polynomials agree on some pairs of long words of two letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE, BASE_INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
BUFFER = 1 << 20
LONG = 64

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BUFFER + 4096), base, U)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
for _c in range(65, 91):
    VALUES[_c] = VALUES[_c + 32]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fill about one buffer each."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BUFFER:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one more entry than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = SPACE[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(buf) and not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, U)
    sums[0] = 0
    np.cumsum(VALUES[buf] * _power(BASE, len(buf)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _power(BASE_INV, len(buf))[starts] + (ends - starts).astype(U))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        word = buf[starts[i] : ends[i]].tobytes().lower()
        words[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, the whole sequence as one."""
    factors = mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    for lo, hi in batches(texts):
        words, at = hashed(texts[lo:hi])
        if len(words) >= n:
            rolled = np.zeros(len(words) - n + 1, U)
            for j in range(n):
                rolled += words[j : len(words) - n + 1 + j] * factors[j]
            rolled = mix(rolled)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                part = np.sort(rolled[a : b - n + 1])
                yield part[np.concatenate(([True], part[1:] != part[:-1]))]
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True, dtype=U) + U(int(b - a)))
            else:
                yield np.empty(0, U)
