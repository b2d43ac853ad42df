"""Fuzzy hashing with the perfect binary Golay code of length 23.

Every vector of 23 bits lies within three bits of exactly one of the 4096 codewords. A vector two or fewer bits
from its codeword has that codeword's index as its one key; one three bits away also gets the five codewords
four bits away. Two vectors that differ in one bit always share a key, in two bits nearly always, in three
often.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Most keys of one vector.
KEYS = 6


def remainder(v: int) -> int:
    """A vector modulo the generator; codewords have none."""
    for k in range(BITS - 1, CHECK - 1, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - CHECK)
    return v


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainder by the low 12 bits, by the high 11 bits, patterns to the codewords nearby by remainder, -1 where fewer)."""
    one = [remainder(1 << k) for k in range(BITS)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for t, at in ((low, 0), (high, 12)):
        for v in range(1, len(t)):
            b = (v & -v).bit_length() - 1
            t[v] = t[v & (v - 1)] ^ one[at + b]
    near: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for n in range(5):
        for c in combinations(range(BITS), n):
            s = 0
            for k in c:
                s ^= one[k]
            if n < 4 or near[s][0].bit_count() == 3:
                near[s].append(sum(1 << k for k in c))
    out = np.full((1 << CHECK, KEYS), -1, np.int32)
    for s, p in enumerate(near):
        out[s, : len(p)] = p
    return low, high, out


def indices(v: np.ndarray) -> np.ndarray:
    """The keys of vectors: 12-bit indices of the codewords nearby, shape (..., KEYS), -1 where there are fewer."""
    low, high, near = tables()
    v = v.astype(np.int32)
    p = near[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(p < 0, -1, (v[..., None] ^ p) >> CHECK)
