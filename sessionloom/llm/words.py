"""Hashes of words and of word sequences for whole batches of texts, in array operations.

Texts are laid end to end as code points; a word's hash comes from prefix sums of a polynomial modulo 2**64, whose base
is odd and therefore has an inverse, so every word costs two look-ups however long it is.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.empty(1 << bits, dtype=np.uint64)
    out[0] = 1
    for b in range(bits):
        out[1 << b : 2 << b] = out[: 1 << b] * np.uint64(pow(base, 1 << b, 1 << 64))
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i below n."""
    return _powers(pow(_BASE, -1, 1 << 64) if inverse else _BASE, max(20, int(n).bit_length()))[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@cache
def _alnum(full: bool) -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000 if full else 0x80)])


def is_alnum(code: np.ndarray) -> np.ndarray:
    return _alnum(bool(code.size and code.max() >= 0x80))[code]


def chunks(texts: list[str], most: int = CHUNK):
    """Index ranges of texts whose lengths sum to about `most` characters, so that memory stays bounded; at most 50000 texts, never split ones."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > most or i - start >= 50_000):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, in order; words are maximal runs of letters and digits in lower case."""
    low = [t.lower() for t in texts]
    code = points("\n".join(low))
    if not code.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_of_texts = np.cumsum([len(t) + 1 for t in low])
    inside = np.concatenate([[False], is_alnum(code), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(code.size), dtype=np.uint64)])
    h = mix((prefix[end] - prefix[begin]) * powers(code.size, inverse=True)[begin])
    return h, np.searchsorted(ends_of_texts, begin, side="right")


def shingle_sets(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (48 bits) of the k-word sequences of each text: (hashes in text order, ascending within one; counts per text)."""
    h, doc = word_hashes(texts)
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = mix(s + h[i : i + n] * np.uint64(2 * i + 3))
    own = doc[:n] == doc[k - 1 :]
    if len(texts) >= 1 << 16:
        raise ValueError("at most 65535 texts at once")
    keyed = np.unique((doc[:n][own].astype(np.uint64) << np.uint64(48)) | (s[own] >> np.uint64(16)))
    return keyed & np.uint64((1 << 48) - 1), np.bincount((keyed >> np.uint64(48)).astype(np.int64), minlength=len(texts))
