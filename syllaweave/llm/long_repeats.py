"""Long exact spans shared between records, by recompression.

A text is a row of tokens (a word with what follows it; a token of more than LONG characters is cut into single
characters). Each round first names runs of one symbol, then names pairs of a left and a right symbol, where a hash of
the symbol decides its side; a pair of more than LONG characters isn't formed, so a longer run parts what stands around
it. Names are 64-bit hashes of what they stand for, so they are the same in every partition without a shared naming
table, and equal substrings get equal symbols except next to their borders: a border costs a token and in each round a
run and a symbol, LONG characters each at most, so in a stretch of ``least`` characters the first
``LONG + 2 * ROUNDS * LONG`` hold the start of a symbol that stands in every copy of it. Every symbol start is an anchor;
the last naming names the ``window`` characters of the symbols from the anchor on. A run that fills the window hides its
borders: its first and its last ``window`` characters are named too. Records that share a stretch so share a name. Shared
names are extended to the full common stretch on the texts themselves, which verifies every character.

A name in more than HOT texts (a notice that many records carry) is not paired up: for its texts the stretches of exactly
``least`` characters around it are named instead, and two texts meet only at a stretch that can't be moved to the left in
both. So a notice shorter than ``least`` pairs nothing, and a longer one gives each pair once. How much of a text is
shared needs no pairs at all: the positions of such stretches that stand in two texts are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from syllaweave.llm import batch as B
from syllaweave.llm.batch import U
from syllaweave.session import small, written

#: Rounds, and characters of a token or a pair at most; 7 * LONG characters at most are lost at a border.
ROUNDS = 3
LONG = 24
#: Texts with one name up to which they are paired directly; beyond it the exact way through whole stretches is taken.
HOT = 32


def recompress(b: np.ndarray, at: np.ndarray, total: np.ndarray, window: int = 1 << 30, rounds: int = ROUNDS, fill: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol names, starts and owners of the texts laid out in ``b`` with running hash ``total``, after ``rounds`` rounds.

    The last array holds the first and the last place in runs of ``window`` characters or more where a window fits; with
    ``fill`` also places between them, a window or less and whole symbols apart.
    """
    runs = [np.zeros(0, np.int64)]
    w = (B.WORD | ((np.arange(256) >= 65) & (np.arange(256) <= 90)) | (np.arange(256) >= 192))[b]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    inner = at[:-1][at[:-1] < len(b)]
    begin[inner] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(b)))
    if (wide := size > LONG).any():
        idx, _ = B.expand(start[wide], size[wide])
        begin[idx] = True
        start = np.flatnonzero(begin)
    doc = np.searchsorted(at, start, "right") - 1
    end = np.append(start[1:], len(b))
    end = np.minimum(end, at[doc + 1] - 1)
    keep = end > start
    start, end, doc = start[keep], end[keep], doc[keep]
    sym = B.span_hash(total, start, end)
    for r in range(1, rounds + 1):
        if len(sym) < 2:
            break
        head = np.ones(len(sym), bool)
        head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        run = np.diff(np.append(first, len(sym)))
        sym, start, doc = sym[first], start[first], doc[first]
        stop = np.minimum(np.append(start[1:], len(b)), at[doc + 1] - 1)
        full = (run > 1) & (stop - start >= window)
        runs += [start[full], stop[full] - window]
        if fill and full.any():
            step = window // (unit := (stop - start)[full] // run[full]) * unit
            k, own = B.expand(np.ones(len(step), np.int64), np.maximum((stop - start)[full] - window, 0) // step)
            runs.append(start[full][own] + k * step[own])
        size = stop - start
        sym = np.where(run > 1, B.mix(sym * U(0xC2B2AE3D27D4EB4F) + run.astype(U)), sym)
        right = (B.mix(sym ^ U(r * 0x9E3779B9)) >> U(63)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= LONG)
        taken = np.zeros(len(sym), bool)
        taken[1:] = pair[:-1]
        named = sym.copy()
        i = np.flatnonzero(pair)
        named[i] = B.mix(sym[i] * U(0x165667B19E3779F9) + sym[i + 1])
        sym, start, doc = named[~taken], start[~taken], doc[~taken]
    return sym, start, doc, np.concatenate(runs)


def _names(window: int, fill: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cls = rb.column(0).to_numpy()
            _, first = np.unique(cls, return_index=True)
            cls, texts = cls[first], rb.column(1).take(pa.array(first)).to_pylist()
            for lo, hi in B.slices([len(t) for t in texts]):
                b, at = B.layout(texts[lo:hi])
                total = B.running(B.values(texts[lo:hi], b))
                _, start, _, runs = recompress(b, at, total, window, fill=fill)
                start = np.unique(np.concatenate([start, runs]))
                doc = np.searchsorted(at, start, "right") - 1
                keep = start + window <= at[doc + 1] - 1
                start, doc = start[keep], doc[keep]
                name = B.span_hash(total, start, start + window)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(cls[lo:hi][doc]), pa.array((start - at[doc]).astype(np.int32))], ["name", "cls", "pos"])

    return run


def _common(a: str, b: str, i: int, j: int) -> int:
    """Length of the common prefix of ``a[i:]`` and ``b[j:]``."""
    n, step, most = 0, 64, min(len(a) - i, len(b) - j)
    while n < most:
        k = min(step, most - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n += k
            step *= 2
        elif k == 1:
            break
        else:
            step = max(1, k // 2)
            most = min(most, n + k)
    return n


def _stretches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[tuple] = []
            col = {n: rb.column(i).to_pylist() for i, n in enumerate(rb.schema.names)}
            reversed_of: dict[int, tuple[str, str]] = {}
            for ca, cb, spots, ta, tb in zip(col["cls_a"], col["cls_b"], col["spots"], col["text_a"], col["text_b"]):
                for k, t in ((ca, ta), (cb, tb)):
                    if k not in reversed_of:
                        reversed_of[k] = (t, t[::-1])
                (fa, ra), (fb, rb_) = reversed_of[ca], reversed_of[cb]
                done: dict[int, int] = {}
                for s in sorted(spots, key=lambda s: s["pos_a"]):
                    i, j = s["pos_a"], s["pos_b"]
                    if i < done.get(i - j, -1):
                        continue
                    back = _common(ra, rb_, len(fa) - i, len(fb) - j)
                    n = back + _common(fa, fb, i, j)
                    done[i - j] = i - back + n
                    if n >= least:
                        out.append((ca, cb, i - back, j - back, n))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["cls_a", "cls_b", "start_a", "start_b", "chars"])

    return run


def _left_first(shared: DataFrame, window: int) -> DataFrame:
    """Pairs of texts with one name; of overlapping names on one diagonal only the first, as one stretch covers them."""
    a = shared.select("name", F.col("cls").alias("cls_a"), F.col("pos").alias("pos_a"))
    b = shared.select("name", F.col("cls").alias("cls_b"), F.col("pos").alias("pos_b"))
    spots = a.join(b, "name").filter("cls_a < cls_b").select("cls_a", "cls_b", "pos_a", "pos_b")
    runs = Window.partitionBy("cls_a", "cls_b", F.col("pos_b") - F.col("pos_a")).orderBy("pos_a")
    return spots.withColumn("prev", F.lag("pos_a").over(runs)).filter(F.col("prev").isNull() | (F.col("pos_a") - F.col("prev") > window)).drop("prev")


def _whole(least: int, window: int):
    """(cls, text, spots) to (name, cls, pos, prev): all stretches of ``least`` characters that hold a hot name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for cls, text, spots in zip(*(rb.column(i).to_pylist() for i in range(3))):
                b, _ = B.layout([text])
                v = B.values([text], b)
                total = B.running(v)
                p = np.array(spots, np.int64)
                i, _ = B.expand(np.maximum(0, p + window - least), np.minimum(p, len(text) - least) - np.maximum(0, p + window - least) + 1) if len(text) >= least else (p[:0], p)
                s = np.unique(i)
                before = np.where(np.concatenate([[False], np.diff(s) == 1]), v[np.maximum(s - 1, 0)].view(np.int64), 0)
                name = B.span_hash(total, s, s + least)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(len(s), cls)), pa.array(s.astype(np.int32)), pa.array(before, mask=before == 0)], ["name", "cls", "pos", "prev"])

    return run


WHOLE = "name bigint, cls bigint, pos int, prev bigint"


def _whole_names(long: DataFrame, at: DataFrame, least: int, window: int) -> DataFrame:
    """Names of all stretches of ``least`` characters around shared names ``(cls, pos)``, those that two texts have."""
    spots = at.groupBy("cls").agg(F.collect_set("pos").alias("spots"))  # places in one text
    texts = long.select("cls", "text").join(spots, "cls").dropDuplicates(["cls"])
    by = Window.partitionBy("name")
    rows = texts.select("cls", "text", "spots").mapInArrow(_whole(least, window), WHOLE)
    return rows.withColumn("lo", F.min("cls").over(by)).withColumn("hi", F.max("cls").over(by)).filter("lo < hi").drop("lo", "hi")


def _hot_spots(long: DataFrame, hot: DataFrame, least: int, window: int) -> DataFrame:
    """Spots of texts with hot names, by names of whole stretches; only where the stretch can't be moved to the left."""
    rows = written(_whole_names(long, hot, least, window), "whole")
    a = rows.select("name", F.col("cls").alias("cls_a"), F.col("pos").alias("pos_a"), F.col("prev").alias("prev_a"))
    b = rows.select("name", F.col("cls").alias("cls_b"), F.col("pos").alias("pos_b"), F.col("prev").alias("prev_b"))
    return a.join(b, "name").filter("cls_a < cls_b and not coalesce(prev_a = prev_b, false)").select("cls_a", "cls_b", "pos_a", "pos_b")


def _classes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("cls"), F.col(text).alias("text")).filter((F.length("text") >= least) & F.col("key").isNotNull())


def _shared_names(long: DataFrame, window: int, fill: bool = False) -> DataFrame:
    """``(name, cls, pos, n)``: the names that two different texts have, with the number of their places (a written table)."""
    names = long.select("cls", "text").mapInArrow(_names(window, fill), "name bigint, cls bigint, pos int")
    by = Window.partitionBy("name")
    shared = names.withColumn("lo", F.min("cls").over(by)).withColumn("hi", F.max("cls").over(by)).filter("lo < hi").select("name", "cls", "pos").distinct()
    return written(shared.withColumn("n", F.count("*").over(by)), "names")


def shared_stretches(docs: DataFrame, key: str, text: str, least: int = 400, window: int = 200) -> tuple[DataFrame, DataFrame]:
    """``members(key, cls)`` of classes of equal texts and ``(cls_a, cls_b, start_a, start_b, chars)`` between classes.

    Every maximal common stretch of ``least`` characters or more of two different texts comes out, with its start on
    both sides. Texts that are NULL or shorter than ``least`` take no part; rows delivered twice count once.
    """
    long = _classes(docs, key, text, least)
    shared = _shared_names(long, window)
    spots = _left_first(shared.filter(F.col("n") <= HOT), window).unionByName(_hot_spots(long, shared.filter(F.col("n") > HOT), least, window))
    pairs = written(spots.groupBy("cls_a", "cls_b").agg(F.collect_set(F.struct("pos_a", "pos_b")).alias("spots")), "spots")
    needed = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    texts = long.join(small(needed), "cls", "left_semi").select("cls", "text").dropDuplicates(["cls"])
    both = pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")
    found = both.select("cls_a", "cls_b", "spots", "text_a", "text_b").mapInArrow(_stretches(least), "cls_a bigint, cls_b bigint, start_a int, start_b int, chars int")
    return long.select("key", "cls").distinct(), found


def document_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs of keys that share a stretch, the smaller key first; copies of one text are pairs too."""
    a, b = (members.select(F.col("key").alias(f"key_{x}"), F.col("cls").alias(f"cls_{x}")) for x in "ab")
    between = found.select("cls_a", "cls_b").distinct().join(a, "cls_a").join(b, "cls_b")
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).filter("key_a < key_b")
    return between.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionByName(within.select("key_a", "key_b"))


def linked(members: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, class_key, n_copies, n_links)``: the least key with an equal text, how many have it, and how many others share a stretch."""
    per = members.groupBy("cls").agg(F.min("key").alias("class_key"), F.count("*").alias("n_copies"))
    ends = found.select("cls_a", "cls_b").distinct()
    both = ends.toDF("cls", "other").unionByName(ends.toDF("other", "cls"))
    n = both.join(per.select(F.col("cls").alias("other"), "n_copies"), "other").groupBy("cls").agg(F.sum("n_copies").alias("others"))
    out = members.join(per, "cls").join(n, "cls", "left")
    return out.select("key", "class_key", "n_copies", (F.col("n_copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def shared_share(docs: DataFrame, key: str, text: str, least: int = 400, window: int = 200) -> DataFrame:
    """``(key, n_chars, shared_chars, share, n_copies)`` for every document; ``shared_chars`` counts each character once.

    A text that stands twice is shared wholly. No pairs are formed: every stretch of ``least`` characters around a shared
    name that two texts have covers its places. A NULL text counts as empty.
    """
    long = _classes(docs, key, text, least)
    rows = _whole_names(long, _shared_names(long, window, True), least, window).select("cls", F.col("pos").alias("s")).distinct()
    before = F.lag("s").over(Window.partitionBy("cls").orderBy("s"))
    covered = rows.withColumn("more", F.least(F.lit(least), F.coalesce(F.col("s") - before, F.lit(least)))).groupBy("cls").agg(F.sum("more").alias("shared"))
    members = long.select("key", "cls").distinct()
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    n = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    base = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), n.alias("n_chars")).distinct().join(members, "key", "left").join(copies.join(covered, "cls", "left"), "cls", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce(F.col("shared"), F.lit(0))).cast("bigint")
    return base.select("key", "n_chars", shared.alias("shared_chars"), F.round(shared / F.greatest("n_chars", F.lit(1)), 6).alias("share"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"))
