"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_STEP = U64(0x9E3779B97F4A7C15)
#: Entries of the word memo of a worker before it is emptied.
MEMO = 150_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


class WordHashes(dict):
    """Memo of word -> 64-bit hash, bounded by ``MEMO``."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_memo = WordHashes()


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of a text, with A-Z (only, as bytes are) in lower case."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), U64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` word hashes, in order."""
    out = np.full(len(h) - n + 1, U64(n), U64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * _STEP + h[i : len(h) - n + 1 + i])
    return out


def shingle_set(text: bytes | str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle; no words: empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    if len(h) < n:
        return gram_hashes(h, len(h))
    return np.unique(gram_hashes(h, n))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def shingle_sets(texts: list[bytes | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sets of ``shingle_set`` one after the other; set i lies in bounds[i]:bounds[i + 1]."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    first = np.concatenate(([0], np.cumsum(sizes)))
    long = gram_hashes(h, n) if len(h) >= n else np.empty(0, U64)
    parts = []
    for i, size in enumerate(sizes.tolist()):
        a = int(first[i])
        if size >= n:
            own = long[a : a + size - n + 1]  # runs that reach into the next text are between these slices
            own.sort()
            parts.append(own)
        elif size:
            parts.append(gram_hashes(h[a : a + size], size))
        else:
            parts.append(long[:0])
    counts = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else long
    if not len(flat):
        return flat, np.zeros(len(texts) + 1, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    new = np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
    kept = np.bincount(owner[new], minlength=len(texts))
    return flat[new], np.concatenate(([0], np.cumsum(kept)))
