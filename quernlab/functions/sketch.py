"""Vectorised word shingles and minwise sketches over whole Arrow batches.

Everything works on the concatenation of a batch's tokens, so the cost is a few
numpy passes per batch and not a Python loop per shingle.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: A worker keeps the hashes of at most this many distinct tokens; the table is emptied beyond it.
TOKEN_CACHE = 100_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C2
        x = (x ^ (x >> np.uint64(27))) * _C3
        return x ^ (x >> np.uint64(31))


class TokenHasher(dict):
    """token -> 64-bit hash, memoised per worker."""

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKEN_CACHE:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


def shingle_batch(texts: list, size: int, hasher: TokenHasher, tokens=None) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct shingle hashes of text i are values[offsets[i]:offsets[i + 1]].

    ``tokens`` splits a lower-cased text; the default takes the runs of [a-z0-9_]. A null text, and
    one of fewer than ``size`` tokens, has no shingles.
    """
    find, flat, lengths = tokens or WORD.findall, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = find(text.lower())
            lengths[i] = len(words)
            flat += words
    h = np.fromiter(map(hasher.__getitem__, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(texts)), lengths)
    offsets = np.zeros(len(texts) + 1, np.int64)
    if len(h) < size:
        return np.empty(0, np.int64), offsets
    with np.errstate(over="ignore"):
        n = len(h) - size + 1
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams = mix64(grams + _C1 + h[k : k + n])
    whole = doc[:n] == doc[size - 1 :]
    grams, doc = grams[whole].view(np.int64), doc[:n][whole]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        first = np.empty(len(grams), bool)
        first[0] = True
        first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[first], doc[first]
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=offsets[1:])
    return grams, offsets


def minhash_bands(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """One 64-bit key per (set, band); sets without members get keys of no meaning."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    sets = len(offsets) - 1
    keys = np.zeros((sets, bands), np.uint64)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(filled):
        return keys.view(np.int64)
    starts, base = offsets[filled], values.view(np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(filled), b + 1, np.uint64)
            for r in range(rows):
                k = b * rows + r
                least = np.minimum.reduceat((base * mult[k] + add[k]) >> np.uint64(24), starts)
                key = mix64(key * _C1 + least)
            keys[filled, b] = key
    return keys.view(np.int64)


def set_ids(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set; equal sets have equal digests."""
    raw, at = values.tobytes(), offsets * 8
    return [xxhash.xxh3_128_digest(raw[at[i] : at[i + 1]]) for i in range(len(offsets) - 1)]
