"""Sets of word shingles as sorted 64-bit fingerprints, for many texts at once in numpy.

Two different shingles share a fingerprint with a chance of 2^-64 a pair, which is below any other source of error.
"""

from __future__ import annotations

import numpy as np
import xxhash

from visitledger.llm.common import fold_case

FOLD = fold_case()
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_random = np.random.Generator(np.random.PCG64(7))
BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP[0]
    h = (h ^ (h >> np.uint64(29))) * STEP[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words (A-Z lower-cased, split at ASCII white space), and the number of words of each text."""
    joined = (b" ".join(texts) + b" ").translate(FOLD)
    data = np.frombuffer(joined, np.uint8)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    inside = np.flatnonzero(~gap)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    h = np.add.reduceat(BYTE[data[inside]] * PLACE[place & 255], first)
    h = mixed(h + lengths.astype(np.uint64) * STEP[2])
    for k in np.flatnonzero(lengths > 256):
        h[k] = xxhash.xxh3_64_intdigest(joined[starts[k]:ends[k]])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints text by text, and their number for each text.

    A text with fewer words than `size` has its whole sequence as the one shingle; one without words has none.
    """
    words, n_words = word_hashes(texts)
    if not len(words):
        return words, np.zeros(len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), n_words)
    n = max(0, len(words) - size + 1)
    tokens = words[:n].copy()
    for k in range(1, size):
        tokens = (tokens ^ (tokens >> np.uint64(31))) * STEP[2 + k] + words[k:n + k]
    tokens = mixed(tokens)
    whole = text[:n] == text[size - 1:] if n else np.zeros(0, bool)
    tokens, text = tokens[whole], text[:n][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.cumsum(n_words) - n_words
        own = [xxhash.xxh3_64_intdigest(words[first[k]:first[k] + n_words[k]].tobytes()) for k in short]
        tokens, text = np.append(tokens, np.array(own, np.uint64)), np.append(text, short)
    order = np.argsort(tokens)
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")] if len(texts) < 1 << 16 else np.lexsort((tokens, text))
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    return tokens[new], np.bincount(text[new], minlength=len(texts))


def set_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One positive 63-bit key for each set; 0 stands for the empty set."""
    ends = np.cumsum(sizes)
    raw = tokens.tobytes()
    return np.array([(xxhash.xxh3_64_intdigest(raw[8 * (e - n):8 * e]) >> 1 | 1) if n else 0
                     for e, n in zip(ends.tolist(), sizes.tolist())], np.int64)
