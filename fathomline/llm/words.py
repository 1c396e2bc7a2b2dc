"""Words and shingles of whole texts as 64-bit hashes, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .unit_encoder import _LOWER, _bytes_of

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, fold: Callable[[bytes], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z in lower case), and where each text's words begin (and the last ends).

    fold maps each distinct word once more; words that become empty are left out.
    """
    import xxhash

    raw, offsets = _bytes_of(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = _LOWER[raw]
    blank = _SPACE[raw]
    cuts = np.zeros(len(raw), bool)
    cuts[1:] = blank[1:] != blank[:-1]
    cuts[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    cuts[0] = True
    starts = np.flatnonzero(cuts)
    units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    distinct = units.dictionary.to_pylist()
    if fold:
        distinct = [fold(w) for w in distinct]
    own = np.fromiter(((w != b"" and w[0] not in b" \t\n\v\f\r") for w in distinct), bool, len(distinct))
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    which = units.indices.to_numpy()
    keep = own[which]
    return hashed[which[keep]], np.searchsorted(starts[keep], offsets)


def shingles(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text, each text's sorted; and where each begins (and the last ends).

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    n = max(len(words) - size + 1, 0)
    runs = np.full(n, size, np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    out, lengths = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + words[k])
            own = one
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        lengths.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
