"""Word-shingle sets of texts and their MinHash signatures, computed a batch at a time."""

from __future__ import annotations

import numpy as np

from .common import mix, shingle_hashes, utf8, word_hashes

POSTED = 64
COMPARED = 192
_random = np.random.default_rng(909)
_A = _random.integers(1, 2**32, COMPARED, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, COMPARED, dtype=np.uint64).astype(np.uint32)
_SET_A, _SET_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(column, size: int):
    """The sorted distinct shingle hashes (uint64) of each text: words in lower case (A-Z), ``size`` a shingle.

    A text of fewer words, but one at least, has its whole sequence as one shingle; one without words has none.
    """
    words, first = word_hashes(*utf8(column))
    shingles = shingle_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        elif b > a:
            yield shingle_hashes(np.append(words[a:b], np.uint64(b - a)), b - a + 1)
        else:
            yield words[:0]


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    return tuple(int(mix(shingles ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in (_SET_A, _SET_B))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """COMPARED coordinates, uint32."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(COMPARED, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * _A + _B).min(0), out=out)
    return out
