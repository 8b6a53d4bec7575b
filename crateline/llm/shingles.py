"""Sets of word shingles as sorted 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

from crateline.llm.common import mix, powers

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WIDTH = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A fixed random value per byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_tables: list[np.ndarray] = [powers(BASE, 1), powers(INVERSE, 1)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        _tables[:] = [powers(BASE, size), powers(INVERSE, size)]
    return _tables


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the lower-cased texts, and the index of each text's first word.

    A word's hash is its span of the prefix sums of byte values times powers, moved to power 0.
    """
    joined = b"\n".join(texts)
    data = LOWER[np.frombuffer(joined, np.uint8)]
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    turn = np.diff(solid)
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = _grown(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[: len(data)], out=prefix[1:])
    hashes = mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, edges)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    words, edges = word_hashes(texts)
    steps = powers(0xD6E8FEB86659FD93, width + 1)[1:]
    n = len(words) - width + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        whole += words[k : k + n] * steps[k]
    whole = mix(whole + np.uint64(width))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * steps[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
