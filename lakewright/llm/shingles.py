"""Word shingles as 64-bit hashes, and one-permutation signatures of them.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z became
a-z. A word's hash is a polynomial of its bytes modulo 2^64; a shingle's hash
mixes the hashes of its words in order. All of it runs over whole arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_MIX = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in parts of about this many bytes, cut between words.
PART = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = _powers(_BASE, 2 * PART), _powers(_INV, 2 * PART)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up = _UP[: len(b)] if len(b) <= len(_UP) else _powers(_BASE, len(b))
    terms = _BYTE[b] * up
    terms[~word] = 0
    sums = np.add.reduceat(terms, start)
    down = _DOWN[start] if len(b) <= len(_DOWN) else _powers(_INV, len(b))[start]
    return mix(sums * down + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a whole text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(raw) <= PART:
        return _hash_words(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_hash_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; a text of fewer words
    has one shingle of them all, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    s = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + w[i: len(w) - k + 1 + i])
    return np.unique(s)


def set_key(s: np.ndarray) -> bytes:
    """Equal for equal sets; 128 bits."""
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a non-empty set with optimal densification:
    one hash deals each element to a bin that keeps its minimum; an empty bin
    copies the first non-empty one on its own pseudo-random walk over the bins,
    the same walk for all sets."""
    h = mix(s ^ np.uint64(0xA0761D6478BD642F))
    where = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, where, h) if len(h) < 64 else _bin_min(out, where, h)
    full = np.zeros(bins, bool)
    full[where] = True
    empty = np.flatnonzero(~full)
    step = 0
    while len(empty):
        step += 1
        salt = np.uint64(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        source = (mix(empty.astype(np.uint64) * np.uint64(0x100000001) + salt) % np.uint64(bins)).astype(np.int64)
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out


def _bin_min(out: np.ndarray, where: np.ndarray, h: np.ndarray) -> None:
    order = np.argsort(h, kind="stable")[::-1]  # the least of a bin is assigned last
    out[where[order]] = h[order]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of a signature of bands * rows bins."""
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[i::rows][:bands])
    return x.view(np.int64)
