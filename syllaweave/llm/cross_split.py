"""Same or near-same records across splits, by content-defined chunks.

A record's words are cut where a rolling hash over two words says so (every second place on average), once for each of
three seeds. Digests of chunks of three words or more are joined across the training split and the others only, and
pairs that share more than one shortest chunk are candidates. Whatever their chunks, all records also meet over bands of
minima of their word sets, so many that a pair at the threshold has none in common with a chance of MISS at most. A band
takes more minima the more records there are, so that unrelated records don't meet more often in a larger table. Pairs
that meet in a band are candidates if a bit of each of 64 minima agrees often enough (four standard deviations of slack).
Candidates are verified by the exact Jaccard of their word sets. The overlap fraction of a verified pair counts the words
of all its shared chunks, of any length and however common. Records with equal word sets are one class; copies in a
batch carry their words once. A digest in more than HOT rows (a common opening) makes no candidates: bands do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from syllaweave.llm import batch as B
from syllaweave.llm.batch import U
from syllaweave.llm.near_duplicates import tolerance, verified
from syllaweave.session import small, written

SEEDS, DIVISOR, LEAST_WORDS, HOT = (1, 2, 3), 2, 3, 256
#: One minimum more in a band for each factor RARE of records; unrelated units agree in a minimum once in about 26 times.
RARE, MISS = 16, 1e-5
#: ``words`` holds 32-bit hashes of the words in their order, NULL in a copy; ``seq`` is a hash of that order.
RECORDS = "id string, unit bigint, train boolean, sid bigint, seq bigint, n int, words array<int>"


def chunks(doc: np.ndarray, h: np.ndarray, seed: int, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, digest and number of words of the chunks of ``least`` words or more."""
    x = B.mix(h ^ U(seed * 0x9E3779B9))
    before = np.concatenate([np.zeros(1, U), x[:-1]])
    last = np.ones(len(h), bool)
    last[:-1] = doc[1:] != doc[:-1]
    before[1:][last[:-1]] = 0
    cut = B.mix(before * U(0x9E3779B97F4A7C15) + x) % U(DIVISOR) == 0
    end = np.flatnonzero(cut | last) + 1
    start = np.concatenate([[0], end[:-1]])
    keep = end - start >= least
    start, end = start[keep], end[keep]
    return doc[start], B.span_hash(B.running(h), start, end), end - start


def make_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit, train, text) to RECORDS; a copy within the batch has no words."""
    for rb in batches:
        texts = [t or "" for t in rb.column(3).to_pylist()]
        train = rb.column(2).to_numpy(zero_copy_only=False)
        seen: set[tuple[int, bool]] = set()
        for lo, hi in B.slices([len(t) for t in texts]):
            n = hi - lo
            doc, h, _, _ = B.words(texts[lo:hi])
            d, u = B.distinct_in(doc, h)
            size = np.diff(np.searchsorted(d, np.arange(n + 1)))
            sid = B.mix(B.group_sum(d, B.mix(u), n) + size.astype(U))
            seq = B.group_sum(doc, B.mix(h + B.mix(np.arange(len(h), dtype=U) - np.searchsorted(doc, doc).astype(U))), n)
            some = np.flatnonzero(size)
            new = np.zeros(n, bool)
            for i in some:
                k = (int(seq[i]), bool(train[lo + i]))
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            short = (h >> U(32)).astype(np.uint32).view(np.int32)[new[doc]]
            count = np.where(new, np.bincount(doc, minlength=n), 0)[some]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(short, pa.int32()), mask=pa.array(~new[some]))
            take = pa.array(some + lo)
            cols = [rb.column(0).take(take), rb.column(1).take(take), rb.column(2).take(take), pa.array(sid.view(np.int64)[some]), pa.array(seq.view(np.int64)[some]), pa.array(size[some].astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["id", "unit", "train", "sid", "seq", "n", "words"])


def _hashes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 64-bit hash of each word of the lists, none of which is empty."""
    count = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(count)), count), B.mix(lists.flatten().to_numpy().view(np.uint32).astype(U) + U(0x2545F491))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, train, words) to (digest, sid, info): ``info`` is twice the length, and one for training."""
    for rb in batches:
        for at in range(0, rb.num_rows, 5_000):
            part = rb.slice(at, 5_000)
            doc, h = _hashes(part.column(2))
            parts = [chunks(doc, h, s) for s in SEEDS]
            d, g, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            sid, train = part.column(0).to_numpy()[d], part.column(1).to_numpy(zero_copy_only=False)[d].astype(np.int64)
            info = np.minimum(c, 0xFFFF) * 2 + train
            order = np.lexsort((info, sid, g))
            g, sid, info = g[order], sid[order], info[order]
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (sid[1:] != sid[:-1]) | (info[1:] != info[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(sid[first]), pa.array(info[first].astype(np.int32))], ["digest", "sid", "info"])


def bands(threshold: float, n_records: int) -> tuple[int, int]:
    """Minima in a band, and bands, so many that all differ in a pair at ``threshold`` with a chance of MISS at most."""
    minima = max(2, math.ceil(math.log(max(n_records, 1), RARE)))
    return minima, math.ceil(math.log(MISS) / math.log1p(-min(threshold**minima, 1 - 1e-9)))


BAND_ROWS, SKETCH_BITS = "digest bigint, sid bigint, train boolean, sketch bigint", 64


def _minima(minima: int, n_bands: int):
    """A function for ``mapInArrow``: (sid, train, words) to BAND_ROWS, a row for each band; each class once in a batch.

    The sketch of a record is a bit of each of its first minima, SKETCH_BITS at most.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sides = rb.column(0).to_numpy() ^ rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.sort(np.unique(sides, return_index=True)[1])
            for at in range(0, len(once), 2_000):
                part = rb.take(pa.array(once[at : at + 2_000]))
                doc, h = _hashes(part.column(2))
                start = np.searchsorted(doc, np.arange(part.num_rows))
                out, sketch, taken = [], np.zeros(part.num_rows, U), 0
                for i in range(n_bands):
                    digest = np.full(part.num_rows, i + 1, U)
                    for j in range(0, minima, 2):  # a 64-bit hash serves for two minima
                        v = B.mix(h ^ U((i * minima + j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                        for x in (v.astype(np.uint32), (v >> U(32)).astype(np.uint32))[: minima - j]:
                            least = np.minimum.reduceat(x, start)
                            digest = B.mix(digest * U(0x9E3779B97F4A7C15) + least)
                            if taken < SKETCH_BITS:
                                sketch |= (B.mix(least.astype(U)) & U(1)) << U(taken)
                                taken += 1
                    out.append(digest)
                each = [part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), sketch.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.tile(x, n_bands)) for x in each)], ["digest", "sid", "train", "sketch"])

    return make


PAIRS = "sid_a bigint, sid_b bigint, seq_a bigint, seq_b bigint, fraction double, sim double"


def _fractions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid_a, sid_b, seq_a, seq_b, sim, words_a, words_b) to PAIRS: the words in shared chunks, of those of the longer text.

    A word counts once for each seed whose chunk around it stands in the other text too.
    """
    for rb in batches:
        for at in range(0, rb.num_rows, 2_000):
            part = rb.slice(at, 2_000)
            n = part.num_rows
            (da, ha), (db, hb) = _hashes(part.column(5)), _hashes(part.column(6))
            total = np.zeros(n)
            for seed in SEEDS:
                (ca, ga, la), (cb, gb, lb) = chunks(da, ha, seed, 1), chunks(db, hb, seed, 1)
                ka, kb = B.mix(ga + B.mix(ca.astype(U))), B.mix(gb + B.mix(cb.astype(U)))
                total += np.minimum(np.bincount(ca, la * np.isin(ka, kb), n), np.bincount(cb, lb * np.isin(kb, ka), n))
            fraction = total / (len(SEEDS) * np.maximum(np.bincount(da, minlength=n), np.bincount(db, minlength=n)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(fraction), part.column(4)], ["sid_a", "sid_b", "seq_a", "seq_b", "fraction", "sim"])


def cross_split(records: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, unit, train, sid, seq)`` and PAIRS: a training text and one of the others, of near-same classes.

    ``records`` has ``id, unit, train, text``. A NULL or word-less text takes no part; repeated rows count once; a class
    that stands on both sides is a pair with itself.
    """
    made = written(records.select(F.col("id").cast("string"), F.col("unit").cast("bigint"), F.col("train").cast("boolean"), F.col("text")).mapInArrow(make_records, RECORDS), "records")
    bodies = made.filter("words is not null")
    # candidates come from one record of each class and side: only rows of repeated classes meet a join
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = bodies.select("sid", "train", "words", at.alias("at"))
    kept = own.groupBy("sid", "train").agg(F.min("at").alias("kept"), F.count("*").alias("c")).filter("c > 1").select("sid", "train", "kept")
    source = own.join(small(kept), ["sid", "train"], "left").filter("kept is null or at = kept").select("sid", "train", "words")
    # a digest's rows are distinct before they are counted, by the same exchange
    flat = source.mapInArrow(_digests, "digest bigint, sid bigint, info int").repartition("digest").distinct()
    by, side = Window.partitionBy("digest"), F.col("info").bitwiseAND(F.lit(1))
    both = flat.withColumn("rows", F.count("*").over(by)).withColumn("some", F.max(side).over(by)).withColumn("every", F.min(side).over(by)).filter("some > every")
    usable = written(both.filter(F.col("rows") <= HOT).select("digest", "sid", (side == 1).alias("train"), F.shiftright("info", 1).alias("len")), "digests")
    a, b = usable.filter("train").select("digest", "len", F.col("sid").alias("sid_a")), usable.filter("not train").select("digest", F.col("sid").alias("sid_b"))
    chunked = a.join(b, "digest").filter("sid_a <> sid_b").groupBy("sid_a", "sid_b").agg(F.sum("len").alias("words")).filter(F.col("words") > LEAST_WORDS).select("sid_a", "sid_b")
    minima, n_bands = bands(threshold, made.count())
    keys, bits = _minima(minima, n_bands), min(SKETCH_BITS, minima * n_bands)
    x, y = (source.filter(c).mapInArrow(keys, BAND_ROWS).select("digest", F.col("sid").alias(f"sid_{s}"), F.col("sketch").alias(f"sketch_{s}")) for c, s in (("train", "a"), ("not train", "b")))
    # records that share a notice meet in many bands but have other minima: their pairs end here, not in the verification
    differ = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b")))
    banded = x.join(y, "digest").filter((F.col("sid_a") != F.col("sid_b")) & (differ <= tolerance(threshold, bits))).select("sid_a", "sid_b")
    pairs = written(chunked.unionByName(banded).distinct(), "pairs")
    sims = verified(pairs, bodies.select("sid", "n", F.col("words").alias("tokens")), threshold).select("sid_a", "sid_b", "sim")
    text = lambda c, s: bodies.filter(c).dropDuplicates(["sid", "seq"]).select(F.col("sid").alias(f"sid_{s}"), F.col("seq").alias(f"seq_{s}"), F.col("words").alias(f"words_{s}"))
    sides = bodies.groupBy("sid").agg(F.max("train").alias("some"), F.min("train").alias("every")).filter("some and not every")
    sims = written(sims.unionByName(sides.select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"), F.lit(1.0).alias("sim"))), "sims")
    needed = lambda c, s: text(c, s).join(sims.select(f"sid_{s}").distinct(), f"sid_{s}", "left_semi")
    full = sims.join(needed("train", "a"), "sid_a").join(needed("not train", "b"), "sid_b")
    found = full.select("sid_a", "sid_b", "seq_a", "seq_b", "sim", "words_a", "words_b").mapInArrow(_fractions, PAIRS)
    return made.select("id", "unit", "train", "sid", "seq").distinct(), found


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(train_id, train_unit, id, unit, fraction, sim)`` for each near-same pair of records of different owners."""
    a = members.filter("train").select(F.col("id").alias("train_id"), F.col("unit").alias("train_unit"), F.col("sid").alias("sid_a"), F.col("seq").alias("seq_a"))
    b = members.filter("not train").select("id", "unit", F.col("sid").alias("sid_b"), F.col("seq").alias("seq_b"))
    between = pairs.join(a, ["sid_a", "seq_a"]).join(b, ["sid_b", "seq_b"])
    return between.select("train_id", "train_unit", "id", "unit", "fraction", "sim").filter("train_id <> id")
