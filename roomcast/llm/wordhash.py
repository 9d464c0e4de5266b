"""64-bit word hashes of whole texts, computed on Arrow buffers without a Python loop over words.

A word is a maximal run of characters other than 0x20 and 0x09-0x0D.  Its hash is
a polynomial over random per-byte values modulo 2**64, taken from running sums of
the whole buffer, divided by the power at the word's start and then mixed, so
equal words hash alike wherever they stand.  Two different words share a hash
with a probability near 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(0, 2**64, 256, dtype=U) | U(1)
_BASE = int(_RNG.integers(0, 2**63, dtype=U)) * 4 + 1 & (2**64 - 1) | 4
_BASE_WORDS = int(_RNG.integers(0, 2**63, dtype=U)) * 4 + 1 & (2**64 - 1) | 4
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}

#: Bytes hashed at once; bounds the memory that the running sums take.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.cumprod(have)
        if size <= BLOCK + 4096:  # a longer table is for one very long text, and goes with it
            _POWERS[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _block_ends(space: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Cuts of the buffer at about BLOCK bytes, never inside a word."""
    n, cuts, at = len(space), [], 0
    while n - at > BLOCK:
        cut = at + BLOCK
        doc_end = int(offsets[np.searchsorted(offsets, cut)]) if cut < offsets[-1] else n
        while cut < doc_end and not space[cut]:
            step = space[cut : min(doc_end, cut + 65536)]
            hit = int(step.argmax())
            if step[hit]:
                cut += hit
                break
            cut += len(step)
        cuts.append(cut)
        at = cut
    return [*cuts, n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (rows + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts_at = ~space
    starts_at[1:] &= space[:-1] | first[1:n]
    ends_at = ~space
    ends_at[:-1] &= space[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    out = np.empty(len(starts), U)
    lo = 0
    for cut in _block_ends(space, offsets):
        a, b = np.searchsorted(starts, (lo, cut))
        if a < b:
            size = cut - lo
            sums = np.zeros(size + 1, U)
            np.cumsum(_VALUE[data[lo:cut]] * _powers(_BASE, size), out=sums[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * _powers(_inverse(_BASE), size)[s] + (e - s).astype(U)
        lo = cut
    return mix(out), np.searchsorted(starts, offsets).astype(np.int64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_BASE_WORDS) + words[j : j + n]
    return mix(out)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[starts[i]:ends[i]] for every i; depends on the words alone."""
    n = len(words)
    sums = np.zeros(n + 1, U)
    np.cumsum(words * _powers(_BASE_WORDS, n), out=sums[1:])
    unshift = _powers(_inverse(_BASE_WORDS), n + 1)[starts]
    return mix((sums[ends] - sums[starts]) * unshift + (ends - starts).astype(U))
