"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are taken in runs of about ``BLOCK`` bytes, a longer
text alone, so memory follows the longest text and not the batch. Hashes are 64-bit polynomials over bytes (mod 2**64),
then mixed; two words or windows with one hash are taken as the same where the caller doesn't compare them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_B, _C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        m = max(n, BLOCK + 1024)
        got = np.full(m, base, U)
        got[0] = 1
        np.cumprod(got, out=got)
        if m <= 4 * BLOCK:
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    first: int  # of the batch's rows, the first of this block
    rows: int
    data: np.ndarray  # bytes of all texts of the block
    ends: np.ndarray  # byte offset at which each text begins, and the end
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    doc: np.ndarray  # row of each word, from 0 in the block
    at: np.ndarray  # index of each row's first word, and the number of words

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """64 bits of each word."""
        return span_hashes(self.data, self.start, self.end, base)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64 bits of each span of ``data``."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(base, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_inverse(base), n)[start] + (end - start).astype(U))


def window_hashes(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64 bits of each run of ``n`` consecutive hashes (across texts too; the caller drops those)."""
    if len(h) < n:
        return np.zeros(0, U)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_inverse(base), len(h))[: len(h) - n + 1])


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK, between: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of ``texts`` (string array, null: no text), block by block; ``between``: of each byte whether it stands between words."""
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, buf = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    every = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        data = every[offsets[first] : offsets[last]]
        if lower:
            data = LOWER[data]
        yield words(data, offsets[first : last + 1] - offsets[first], first, between)
        first = last


def words(data: np.ndarray, ends: np.ndarray, first: int = 0, between: np.ndarray = SPACE) -> Words:
    rows = len(ends) - 1
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    inner = ends[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    begins[cut] |= solid[cut]
    stops[cut - 1] |= solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    at = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(rows), np.diff(at))
    return Words(first, rows, data, ends, start, end, doc, at)


def same_doc(w: Words, n: int) -> np.ndarray:
    """Whether the ``n`` words from each on are of one text."""
    if len(w.doc) < n:
        return np.zeros(0, bool)
    return w.doc[: len(w.doc) - n + 1] == w.doc[n - 1 :]
