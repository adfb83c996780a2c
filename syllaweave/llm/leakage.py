"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

Queries are all windows of ``least`` words of the test items, as sets of five-word shingles; a leak is a window that is
contained wholly. Documents are laid out as pieces of at most MAX_PIECE shingles that overlap so far that every window
lies whole in one piece, and pieces are partitioned by their size. A window of w shingles contained in a piece of at most
u has Jaccard w / u or more with it, so a partition takes as many minima as make the chance of no common minimum
``miss`` at most. Pieces that share a minimum with a window are candidates, and a candidate is verified by exact
containment of the window's consecutive shingles.

Up to BLOCK test items are sent to the workers. More of them stay a table: the corpus is read once, and its pieces meet
the items over the same minima and the same windows in joins. Both ways find the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from syllaweave.llm import batch as B
from syllaweave.llm.batch import U
from syllaweave.session import bounded_rows

SHINGLE = 5
MAX_PIECE = 64
SIZES = (16, 32, MAX_PIECE)
#: Test items that are sent to the workers.
BLOCK = 5_000


def bands(window: int, most: int, miss: float) -> int:
    """Minima that a partition of pieces of at most ``most`` shingles needs."""
    j = min(1.0, window / most)
    return 1 if j >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - j)))


def _windows(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word index and hash of every run of ``n`` words inside one text."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    i = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return i, B.span_hash(B.running(h), i, i + n)


def _factors(count: int) -> np.ndarray:
    return B.mix(np.arange(1, count + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def _pieces(doc: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, and the first shingle, the end and the text of every piece."""
    width = least - SHINGLE + 1
    at, sh = _windows(doc, h, SHINGLE)
    if not len(sh):
        return sh, *(np.zeros(0, np.int64) for _ in range(3))
    sdoc = doc[at]
    edge = np.flatnonzero(np.concatenate([[True], sdoc[1:] != sdoc[:-1], [True]]))
    begin, size = edge[:-1], np.diff(edge)
    step = MAX_PIECE - width + 1
    k, text = B.expand(np.zeros(len(size), np.int64), np.maximum(1, -(-(size - width + 1) // step)))
    lo = begin[text] + k * step
    hi = np.minimum(lo + MAX_PIECE, begin[text] + size[text])
    keep = hi - lo >= width
    return sh, lo[keep], hi[keep], sdoc[lo[keep]]


def _piece_minima(sh: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Band, pieces and their minima; a piece has as many bands as its size needs."""
    factors, least_size = _factors(max(need)), 0
    for u, n in zip(SIZES, need):
        part = np.flatnonzero((hi - lo > least_size) & (hi - lo <= u))
        least_size = u
        if len(part):
            idx, owner = B.expand(lo[part], hi[part] - lo[part])
            s = sh[idx]
            cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for band in range(n):
                yield band, part, np.minimum.reduceat(s * factors[band], cut)


class Index:
    """Minima of the windows of a block of test items, for each band, and the windows' hashes for the verification."""

    def __init__(self, items: list[tuple[int, str]], least: int, miss: float) -> None:
        self.least, self.width, self.miss = least, least - SHINGLE + 1, miss
        self.need = [bands(self.width, u, miss) for u in SIZES]
        ids = np.array([i for i, _ in items], np.int64)
        doc, h, _, _ = B.words([t or "" for _, t in items])
        at, whole = _windows(doc, h, least)
        first, sh = _windows(doc, h, SHINGLE)
        self.whole, self.item = whole, ids[doc[at]]
        order = np.argsort(whole, kind="stable")
        self.whole, self.item = whole[order], self.item[order]
        self.minima: list[tuple[np.ndarray, np.ndarray]] = []
        if len(at):
            rank = np.searchsorted(first, at)
            grid = sh[rank[:, None] + np.arange(self.width)[None]]
            owner = ids[doc[at]]
            for f in _factors(max(self.need)):
                m = (grid * f).min(axis=1)
                pairs = np.unique(np.stack([m.view(np.int64), owner]), axis=1)
                order = np.argsort(pairs[0].view(U), kind="stable")
                self.minima.append((pairs[0][order].view(U), pairs[1][order]))

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text index and item of every verified leak."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.minima:
            return none
        doc, h, _, _ = B.words(texts)
        sh, lo, hi, text = _pieces(doc, h, self.least)
        found_piece, found_item = [], []
        for band, part, m in _piece_minima(sh, lo, hi, self.need):
            keys, items = self.minima[band]
            a, b = np.searchsorted(keys, m, "left"), np.searchsorted(keys, m, "right")
            hit = np.flatnonzero(b > a)
            if len(hit):
                i, o = B.expand(a[hit], b[hit] - a[hit])
                found_piece.append(part[hit][o])
                found_item.append(items[i])
        if not found_piece:
            return none
        cand = np.unique(np.stack([np.concatenate(found_piece), np.concatenate(found_item)]), axis=1)
        # exact containment: a window of the item stands in the piece, word for word
        pieces = np.unique(cand[0])
        idx, owner = B.expand(lo[pieces], hi[pieces] - lo[pieces] - self.width + 1)
        start = _windows(doc, h, SHINGLE)[0][idx]
        w = B.span_hash(B.running(h), start, start + self.least)
        a, b = np.searchsorted(self.whole, w, "left"), np.searchsorted(self.whole, w, "right")
        hit = np.flatnonzero(b > a)
        i, o = B.expand(a[hit], b[hit] - a[hit])
        real = np.unique(np.stack([pieces[owner[hit][o]], self.item[i]]), axis=1)
        both = np.unique(np.concatenate([cand, real], axis=1), axis=1, return_counts=True)
        ok = both[0][:, both[1] == 2]
        return text[ok[0]], ok[1]


def _searcher(items: list[tuple[int, str]], least: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, least, miss)
        for rb in batches:
            keys, texts = rb.column(0), [t or "" for t in rb.column(1).to_pylist()]
            for lo, hi in B.slices([len(t) for t in texts]):
                doc, item = index.search(texts[lo:hi])
                if len(doc):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc + lo)), pa.array(item)], ["key", "item"])

    return run


def _named(m: np.ndarray, band: int) -> np.ndarray:
    return B.mix(m + U(band + 1)).view(np.int64)


def _rows(key: pa.Array, piece: np.ndarray, kind: bool, names: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(piece.astype(np.int64)), pa.array(np.full(len(names), kind)), pa.array(names)], ["key", "piece", "exact", "name"])


ROWS = "key bigint, piece bigint, exact boolean, name bigint"


def _document_names(least: int, miss: float):
    """(key, text) to ROWS: the minima and the windows of every piece of a document."""
    need = [bands(least - SHINGLE + 1, u, miss) for u in SIZES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [t or "" for t in rb.column(1).to_pylist()]
            for lo_, hi_ in B.slices([len(t) for t in texts]):
                doc, h, _, _ = B.words(texts[lo_:hi_])
                sh, lo, hi, text = _pieces(doc, h, least)
                if not len(lo):
                    continue
                keys = rb.column(0).take(pa.array(text + lo_))
                for band, part, m in _piece_minima(sh, lo, hi, need):
                    yield _rows(keys.take(pa.array(part)), lo[part], False, _named(m, band))
                idx, owner = B.expand(lo, hi - lo - (least - SHINGLE))
                start = _windows(doc, h, SHINGLE)[0][idx]
                yield _rows(keys.take(pa.array(owner)), lo[owner], True, B.span_hash(B.running(h), start, start + least).view(np.int64))

    return run


def _item_names(least: int, miss: float):
    """(item, text) to ROWS: the minima and the hashes of every window of a test item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            index = Index(list(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())), least, miss)
            for band, (m, items) in enumerate(index.minima):
                yield _rows(pa.array(items), np.zeros(len(m)), False, _named(m, band))
            yield _rows(pa.array(index.item), np.zeros(len(index.item)), True, index.whole.view(np.int64))

    return run


def _joined(base: DataFrame, clean: DataFrame, least: int, miss: float) -> DataFrame:
    names = clean.mapInArrow(_item_names(least, miss), ROWS).select(F.col("key").alias("item"), "exact", "name").distinct()
    met = base.mapInArrow(_document_names(least, miss), ROWS).join(names, ["exact", "name"])
    # a piece shares a minimum with the item, and a whole window
    both = met.groupBy("key", "piece", "item").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).filter("b and not a")
    return both.select("key", "item")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, least: int = 15, miss: float = 1e-5) -> DataFrame:
    """``(key, item)`` for each document with at least ``least`` consecutive words of a test item in the item's order.

    Items of fewer words and NULL or empty texts give no row; repeated rows count once. Keys and items are BIGINT.
    """
    clean = items.select(F.col(item).cast("bigint").alias("item"), F.col(passage).alias("text")).filter(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    listed = bounded_rows(clean, BLOCK)
    found = base.mapInArrow(_searcher(sorted(map(tuple, listed)), least, miss), "key bigint, item bigint") if listed is not None else _joined(base, clean, least, miss)
    return found.distinct()
