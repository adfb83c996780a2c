"""Vectorised text hashing for Arrow batches: no Python loop over characters or words.

A text is laid out as one byte for each code point (code points over 255 become a non-word byte), so offsets are code
point offsets. Substring hashes come from one running polynomial sum modulo 2**64 over random byte values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123)]] = True
#: Characters that are hashed at a time; a longer text is a slice of its own.
SLICE_CHARS = 400_000
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_CHARS + 1)
        for k, base in ((0, BASE), (1, INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers


def layout(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts joined by a line feed, and where each text starts (with one end mark more)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    b = np.frombuffer("\n".join(texts).encode("latin-1", "replace"), np.uint8)
    return b, np.concatenate([[0], np.cumsum(sizes + 1)])


def values(texts: list[str], b: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point of the laid-out texts, another one for each code point over 255 too."""
    v = BYTE[b]
    joined = "\n".join(texts)
    if not joined.isascii():
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        far = np.flatnonzero(cp > 255)
        v[far] = mix(cp[far].astype(U) * U(0xFF51AFD7ED558CCD)) | U(1)
    return v


def running(values: np.ndarray) -> np.ndarray:
    """Running polynomial sum of 64-bit values."""
    p = powers(len(values) + 1)[0]
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], dtype=U, out=out[1:])
    return out


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``, equal for equal content wherever it stands."""
    return mix((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(U) * U(0x632BE59BD9B4E019))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: text index, hash, start and end of every maximal run of a-z and 0-9, in order."""
    b, at = layout([t.lower() for t in texts])
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z.astype(U), z, z
    w = np.diff(np.concatenate([[False], WORD[b], [False]]).astype(np.int8))
    start, end = np.flatnonzero(w == 1), np.flatnonzero(w == -1)
    doc = np.searchsorted(at, start, "right") - 1
    return doc, span_hash(running(BYTE[b]), start, end), start - at[doc], end - at[doc]


def distinct_in(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, h) pairs, sorted; ``doc`` is sorted already."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[keep], x[keep]


def group_sum(doc: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of ``v`` for each of the ``n`` sorted groups ``doc``."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` for all i in one array, and the i of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(owner)) - before[owner] + starts[owner], owner
