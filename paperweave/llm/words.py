"""Words of whole texts as 64-bit hashes, computed with numpy a block of texts at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D. A word's hash is a
polynomial in its bytes modulo 2**64, read off one running sum over the block, so no
Python object is made for a word. Equal words have equal hashes everywhere: the constants
below are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) of about BLOCK_BYTES each; one long text may be a block of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def word_table(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: hashes of all words in order, where each text's words begin
    (one entry more than texts), and each word's first and end byte in b"\\n".join(texts)."""
    buf = b"\n".join(texts) + b"\n"
    if lower:
        buf = buf.translate(LOWER)
    a = np.frombuffer(buf, np.uint8)
    gap = _GAP[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([np.zeros(1, edge.dtype), edge])
    first, end = edge[::2], edge[1::2]
    up, down = _power(len(a))
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    hashes = mix((total[end] - total[first]) * down[first])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, begins, first, end


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, text borders ignored (len - n + 1 values)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    h = words[:k].copy()
    for i in range(1, n):
        h *= _STEP
        h += words[i : i + k]
    return mix(h + np.uint64(n))


def word_sets(texts: list[bytes], n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, ascending. With fewer than n words the whole
    sequence is one shingle; without words the set is empty."""
    for _, some in blocks(texts):
        words, begins, _, _ = word_table(some, lower)
        all_grams = grams(words, n)
        for b, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if e - b >= n:
                yield np.unique(all_grams[b : e - n + 1])
            else:
                yield grams(words[b:e], e - b) if e > b else np.empty(0, np.uint64)
