"""Helpers shared by the operators of this subpackage: lineage cuts, Arrow text access, word hashing."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspan.session import stage as checkpointed  # noqa: F401  cut lineage in the shared folder

#: ASCII white space, as the contracts define it: [\x20\x09-\x0D].
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
BLOCK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined(items, sep: str) -> Column:
    return F.array_join(items, sep)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the int64 offsets of an Arrow string array, without a copy of the bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset of one text (its end included), the code points before it."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, starts_at: np.ndarray | None = None, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each white-space separated word of ``raw``, A-Z lower-cased.

    ``starts_at`` gives further offsets where a word may not run across (document limits).  With ``letters``, words are
    runs of ASCII letters, digits and non-ASCII characters, and Latin-1 capitals are lower-cased as well.  The hash of a word
    is a polynomial in its bytes modulo 2**64, read off a running sum, so a block costs a few array passes.
    """
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    low = _LOWER[raw]
    if letters:
        capital = np.flatnonzero(raw == 0xC3) + 1
        capital = capital[capital < n]
        capital = capital[(raw[capital] >= 0x80) & (raw[capital] <= 0x9E) & (raw[capital] != 0x97)]
        low[capital] += 32
    inside = ~(_NO_LETTER if letters else _IS_SPACE)[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if starts_at is not None:
        cut = starts_at[(starts_at > 0) & (starts_at < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _PRIME, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", _INVERSE, n)[starts]), starts, ends


def word_blocks(texts: pa.Array, overlap: int = 0, letters: bool = False):
    """Yield (doc, hash, start, end, fresh) for blocks of whole documents of about ``BLOCK_BYTES``.

    ``doc`` is the row of each word, ``start`` and ``end`` its byte range in its own text.  A text longer than a
    block comes in several blocks cut at white space; each later block repeats the ``overlap`` words before it,
    and ``fresh`` is the number of such repeated words at its front.
    """
    raw, off = buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + BLOCK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        if j > i + 1 or off[j] - off[i] <= BLOCK_BYTES:
            lo, hi = off[i], off[j]
            h, s, e = word_hashes(raw[lo:hi], off[i:j] - lo, letters)
            doc = np.searchsorted(off[i : j + 1] - lo, s, side="right") - 1
            base = off[i:j][doc] - lo if len(doc) else doc
            yield doc + i, h, s - base, e - base, 0
        else:
            yield from _long(raw[off[i] : off[j]], i, overlap, letters)
        i = j


def _long(raw: np.ndarray, row: int, overlap: int, letters: bool):
    at, keep_h, keep_s, keep_e = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while at < len(raw):
        end = min(at + BLOCK_BYTES, len(raw))
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            step = np.flatnonzero(_IS_SPACE[raw[end : end + BLOCK_BYTES]])
            end = end + int(step[0]) if len(step) else min(end + BLOCK_BYTES, len(raw))
        h, s, e = word_hashes(raw[at:end], None, letters)
        fresh = len(keep_h)
        h, s, e = np.concatenate([keep_h, h]), np.concatenate([keep_s, s + at]), np.concatenate([keep_e, e + at])
        yield np.full(len(h), row), h, s, e, fresh
        if overlap:
            keep_h, keep_s, keep_e = h[-overlap:], s[-overlap:], e[-overlap:]
        at = end


def shingle_hashes(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words that lies in one document, and the position of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(out[at]), at


def doc_groups(off: np.ndarray, size: int = 1 << 22):
    """Row ranges (i, j) of about ``size`` bytes; a longer text is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + size, side="right")) - 1, i + 1), n)
        yield i, j
        i = j


def runs(inside: np.ndarray, limits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of at least ``least`` true values; a run ends at every offset in ``limits``."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = limits[(limits > 0) & (limits < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


class Spans:
    """Sorted spans of one text, asked for overlaps in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):  # overlapping ones become one
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def gaps(self, start: int, end: int):
        """The parts of a range that lie in no span, in order."""
        at = bisect_right(self.ends, start)
        while at < len(self.starts) and self.starts[at] < end:
            if self.starts[at] > start:
                yield start, self.starts[at]
            start, at = max(start, self.ends[at]), at + 1
        if start < end:
            yield start, end
