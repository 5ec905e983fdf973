"""Likeness of a phrase to its best window in a text, where no built-in function has the measure."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters of texts that are compared at once, or one text if that is longer.
CHARS_AT_ONCE = 1 << 18


def _common(masks: dict[str, int], n: int, window: str) -> int:
    """Length of the common subsequence of a window and a phrase of n characters, whose places are bits of the masks."""
    v = full = (1 << n) - 1
    for c in window:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return n - v.bit_count()


def _best(short: str, long: str) -> float:
    masks: dict[str, int] = {}
    n = len(short)
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    windows = (long[max(0, s) : s + n] for s in range(1 - n, len(long)))
    return max(200.0 * _common(masks, n, w) / (n + len(w)) for w in windows)


def window_ratio(phrase: str, text: str) -> float:
    """100 * twice the common subsequence length over both lengths, at the best of all windows of the shorter one's length, which may hang over both ends."""
    if not phrase or not text:
        return 0.0
    short, long = sorted((phrase, text), key=len)
    if short in long:
        return 100.0
    return max(_best(short, long), _best(long, short)) if len(short) == len(long) else _best(short, long)


def _best_of_each(phrase: str, texts: list[str]) -> np.ndarray:
    """window_ratio of texts longer than the phrase, of at most 64 characters: all windows at once, one bit for each place of the phrase."""
    m = len(phrase)
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if m <= 8 * t().itemsize)
    other = next(chr(i) for i in range(m + 1) if chr(i) not in phrase)
    joined = other * m + "".join(t + other * m for t in texts)
    if joined.isascii():
        codes = np.frombuffer(joined.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(max(int(codes.max()), *map(ord, phrase)) + 1, kind)
    for i, c in enumerate(phrase):
        table[ord(c)] |= kind(1 << i)
    places = table[codes]
    n = len(codes) - m + 1
    v, u = np.full(n, kind((1 << m) - 1)), np.empty(n, kind)
    for j in range(m):
        np.bitwise_and(v, places[j : j + n], out=u)
        rest = v - u
        v += u
        v |= rest
    common = m - np.bitwise_count(v & kind((1 << m) - 1)).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + m)
    starts = ends - lengths
    best = 200.0 * np.maximum.reduceat(common, np.stack([starts, ends - m + 1], axis=1).ravel())[::2] / (2 * m)
    k = np.arange(1, m)  # characters of the windows that hang over the ends
    for at in (starts[:, None] - m + k, ends[:, None] - k):
        best = np.maximum(best, (200.0 * common[at] / (m + k)).max(axis=1, initial=0.0))
    return best


def _portions(texts: list[str], which: list[int]) -> Iterator[list[int]]:
    part: list[int] = []
    n = 0
    for i in which:
        if part and n + len(texts[i]) > CHARS_AT_ONCE:
            yield part
            part, n = [], 0
        part.append(i)
        n += len(texts[i])
    if part:
        yield part


def window_ratios(phrases: list[str], texts: list[str]) -> list[float]:
    """window_ratio of each pair, with texts that meet the same phrase compared together."""
    out = [0.0] * len(texts)
    together: dict[str, list[int]] = {}
    for i, (phrase, text) in enumerate(zip(phrases, texts, strict=True)):
        if 0 < len(phrase) <= 64 and len(text) > len(phrase) and phrase not in text:
            together.setdefault(phrase, []).append(i)
        else:
            out[i] = window_ratio(phrase, text)
    for phrase, which in together.items():
        for part in _portions(texts, which):
            for i, x in zip(part, _best_of_each(phrase, [texts[i] for i in part]).tolist(), strict=True):
                out[i] = x
    return out


def may_resemble(phrase: str, text: Column, least: float) -> Column:
    """Can window_ratio() of the phrase and the text reach `least` (0 to 100)? In SQL functions alone, never wrong in saying no.

    A window that does needs at most d = (1 - least / 100) * 2 * length insertions and deletions. Of d + 1 pieces of the phrase each of those touches one at most, so one piece is in the text as it is. A text shorter
    than the phrase may have lost pieces, and is let through."""
    m = len(phrase)
    d = min(m - 1, int((1 - least / 100) * 2 * m + 1e-9))
    cuts = [m * i // (d + 1) for i in range(d + 2)]
    pieces = sorted({phrase[a:b] for a, b in zip(cuts, cuts[1:], strict=False)})
    return (F.length(text) < m) | reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in pieces))


def bounded_ratio(phrase: str, text: Column, least: float, but: Column | None = None) -> Column:
    """partial_ratio() where it may reach `least`, else 0: other texts, and those where `but` holds, go to Python as empty ones."""
    asked = may_resemble(phrase, text, least)
    return partial_ratio(F.lit(phrase), F.when(asked & ~but if but is not None else asked, text).otherwise(F.lit("")))


@F.arrow_udf(DoubleType())
def partial_ratio(phrase: pa.Array, text: pa.Array) -> pa.Array:
    return pa.array(window_ratios([x or "" for x in phrase.to_pylist()], [x or "" for x in text.to_pylist()]), pa.float64())
