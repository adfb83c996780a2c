"""Near-duplicate records with small edits: a chosen-path similarity join.

Each record is its set of distinct words; records with equal sets are one class, and only one record of a class goes on.
In every run a record walks random paths: at a node it keeps each of its words with probability ``1 / (threshold *
size)``, decided by a hash of path and word, so that two records at the threshold share one child in expectation. A path
ends once the expected bucket is small: the product of its words' document frequencies times the number of records is at
most ``bucket``. Frequent words have their counted frequency (a table of at most FREQUENT entries, whatever the corpus),
rarer ones count as the least frequent of them. Buckets arrive sorted by their path and are compared as they stream by,
by a 128-bit sketch of each record; pairs that pass are verified on the whole sets. There are as many runs as it takes
to meet a pair at the threshold, one set inside the other, with the chance RECALL by a branching model over the counted
word frequencies.

Words that stand together (a notice that a third of the records carry) make a bucket larger than its path predicts. The
records of a bucket over LARGE are split further, on their rarest words: two sets at the threshold or above share one of
the ``n - ceil(threshold * n) + 1`` rarest words of each, so these buckets lose nothing. What is still over LARGE, and any
bucket in which more than DENSE pairs a record have close sketches (records that are alike, but not alike enough), is
compared exactly: as pairs of blocks of BLOCK records, spread over tasks, by products of their word matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from syllaweave.llm import batch as B
from syllaweave.llm.batch import U
from syllaweave.operators.graph import components
from syllaweave.session import BROADCAST_KEYS, small, written

#: Words of a sketch.
SKETCH = ["s1", "s2"]
_KINDS = ", ".join(f"{c} bigint" for c in SKETCH)
SET_SCHEMA = f"key string, sid bigint, n int, {_KINDS}, tokens array<int>"
#: A token's frequency is counted from this share of the records on, or from the share that FREQUENT tokens can reach.
HEAVY, FREQUENT = 1 / 1000, 100_000
MAX_DEPTH = 9
#: Chance that the runs meet a pair at the threshold.
RECALL = 0.9995
#: Records that a bucket is expected to hold at the end of a path, and that it may hold before it is split further.
BUCKET, LARGE = 2_048, 8_192
#: Pairs with close sketches for each record of a bucket, beyond which it is compared exactly; records in a block; bucket size that is compared by itself.
DENSE, BLOCK, WIDE = 32, 1_024, 256


def _sketch(doc: np.ndarray, h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64 one-bit minima: words fall into 64 bins, and each bin gives a bit of its least hash.

    A set of a hundred words leaves few of 64 bins empty; in more bins, empty ones would agree by themselves.
    """
    v = B.mix(h ^ U(seed))
    cell = doc * 64 + (v >> U(58)).astype(np.int64)
    order = np.lexsort((v, cell))
    c, x = cell[order], v[order]
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    bits = np.zeros(n * 64, U)
    bits[c[first]] = B.mix(x[first]) & U(1)
    return (bits.reshape(n, 64) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)


def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to one row of SET_SCHEMA for each record that has a word; a copy within the batch has no tokens."""
    for rb in batches:
        keys, texts = rb.column(0), [t or "" for t in rb.column(1).to_pylist()]
        seen = np.zeros(0, np.int64)
        for lo, hi in B.slices([len(t) for t in texts]):
            doc, h, _, _ = B.words(texts[lo:hi])
            doc, h = B.distinct_in(doc, h)
            n = hi - lo
            size = np.diff(np.searchsorted(doc, np.arange(n + 1)))
            sid = B.mix(B.group_sum(doc, B.mix(h), n) + size.astype(U)).view(np.int64)
            new = np.zeros(n, bool)
            new[np.unique(sid, return_index=True)[1]] = True
            new &= (size > 0) & ~np.isin(sid, seen)
            seen = np.concatenate([seen, sid[new]])
            some = np.flatnonzero(size)
            tokens = (h >> U(32)).astype(np.uint32).view(np.int32)[new[doc]]
            offsets = np.concatenate([[0], np.cumsum(np.where(new, size, 0)[some])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.int32()), mask=pa.array(~new[some]))
            sketch = [_sketch(doc, h, n, seed).view(np.int64)[some] for seed in (0x1234567, 0x89ABCDE)]
            cols = [keys.take(pa.array(some + lo)), pa.array(sid[some]), pa.array(size[some].astype(np.int32)), *map(pa.array, sketch), lists]
            yield pa.RecordBatch.from_arrays(cols, ["key", "sid", "n", *SKETCH, "tokens"])


def word_sets(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Sets of distinct words (32-bit hashes), their 64-bit class id and sketch."""
    return df.select(F.col(key).cast("string").alias("key"), text.alias("text")).mapInArrow(make_sets, SET_SCHEMA)


def bodies(sets: DataFrame) -> DataFrame:
    """One row with tokens for each class of ``sets`` (a written table); only rows of repeated classes meet a join."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = sets.filter("tokens is not null").withColumn("at", at)
    kept = own.groupBy("sid").agg(F.min("at").alias("kept"), F.count("*").alias("c")).filter("c > 1").select("sid", "kept")
    return own.join(small(kept), "sid", "left").filter("kept is null or at = kept").drop("at", "kept", "key")


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        t, c = np.unique(rb.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["token", "c"])


def runs_needed(logs: np.ndarray, floor: float, n_records: int, mean_size: float, bucket: int, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with the chance ``recall``, at the size ratio that is hardest.

    With one set inside the other a node has one common child in expectation (Poisson, which is below the binomial), with
    equal sets more. A common path goes on until the frequencies of its words, drawn as often as records hold them, have
    used up the logarithm that ends it. The chance of one run falls as that gets longer with the number of records.
    """
    step = 0.05
    share = np.exp(logs) / max(mean_size, 1.0)
    total = min(1.0, share.sum())
    # used-up logarithms round upwards to a path that is longer by less than one step a word
    used = np.bincount(np.minimum((-logs / step).astype(int), int(-floor / step)), share, int(-floor / step) + 1)
    used = used.astype(float)
    used[-1] += 1 - total
    used /= used.sum()
    left = max(0, math.ceil(math.log(max(n_records, 1) / bucket) / step))
    chance = np.ones(left + 1)
    for _ in range(MAX_DEPTH):
        # after a word that uses up u steps: 1 if nothing is left, else the chance of the rest
        after = [sum(used[u] * (1.0 if u >= s else chance[s - u]) for u in range(len(used))) for s in range(left + 1)]
        chance = 1 - np.exp(-np.array(after))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-chance[left])))


def frequent_tokens(sets: DataFrame, n_records: int, mean_size: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens from a least share of the records on, the logarithms of their shares, and that of the least share.

    Shares are counted over all records. At most ``mean_size / share`` tokens reach a share, so at most FREQUENT come out.
    """
    share = max(HEAVY, mean_size / FREQUENT)
    least = max(2, math.ceil(share * n_records))
    counted = sets.select("tokens").mapInArrow(_count_tokens, "token int, c bigint").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    rows = sorted(tuple(r) for r in counted.collect())  # FREQUENT rows at most
    return np.array([r[0] for r in rows], np.int32), np.log(np.array([max(r[1], 1) / max(n_records, 1) for r in rows])), math.log(share)


def _logs(tokens: np.ndarray, heavy: np.ndarray, logs: np.ndarray, floor: float) -> np.ndarray:
    if not len(heavy):
        return np.full(len(tokens), floor)
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    return np.where(heavy[at] == tokens, logs[at], floor)


def _token_hash(tokens: np.ndarray) -> np.ndarray:
    return B.mix(tokens.view(np.uint32).astype(U) + U(0x51ED270B))


ROWS = f"path bigint, sid bigint, {_KINDS}"


def paths(heavy: np.ndarray, logs: np.ndarray, floor: float, n_records: int, threshold: float, runs: int, bucket: int):
    """A function for ``mapInArrow``: (sid, n, SKETCH, tokens) to ROWS, a row for each path that ends."""
    stop = math.log(bucket / max(n_records, 1))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sid, n, *sketch = (rb.column(i).to_numpy() for i in range(2 + len(SKETCH)))
            offsets, tokens = rb.column(2 + len(SKETCH)).offsets.to_numpy(), rb.column(2 + len(SKETCH)).values.to_numpy()
            for lo in range(0, len(sid), 400):
                some = np.arange(lo, min(lo + 400, len(sid)))
                starts, size = offsets[some].astype(np.int64), n[some].astype(np.int64)
                index, owner = B.expand(starts, size)
                t = tokens[index]
                log, th = _logs(t, heavy, logs, floor), _token_hash(t)
                begin = np.cumsum(size) - size
                most = np.minimum(2.0**64 - 2049, 2.0**64 / (threshold * size)).astype(U)
                doc = np.repeat(np.arange(len(some)), runs)
                path = np.tile(B.mix(np.arange(1, runs + 1, dtype=U) * U(0xD6E8FEB86659FD93)), len(some))
                logp = np.zeros(len(doc))
                out_doc, out_path = [], []
                if stop >= 0:  # no more records than a bucket holds: they are compared as they are
                    out_doc, out_path, doc, path, logp = [np.arange(len(some))], [np.ones(len(some), U)], doc[:0], path[:0], logp[:0]
                for depth in range(1, MAX_DEPTH + 1):
                    idx, own = B.expand(begin[doc], size[doc])
                    keep = np.flatnonzero(B.mix(th[idx] ^ path[own]) < most[doc[own]])
                    idx, own = idx[keep], own[keep]
                    doc, path, logp = doc[own], B.mix(path[own] * U(0x9E3779B97F4A7C15) + th[idx]), logp[own] + log[idx]
                    done = (logp <= stop) | (depth == MAX_DEPTH)
                    out_doc.append(doc[done])
                    out_path.append(path[done])
                    doc, path, logp = doc[~done], path[~done], logp[~done]
                row = some[np.concatenate(out_doc)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_path).view(np.int64)), pa.array(sid[row]), *(pa.array(x[row]) for x in sketch)], ["path", "sid", *SKETCH])

    return walk


def rarest(heavy: np.ndarray, logs: np.ndarray, floor: float, threshold: float):
    """A function for ``mapInArrow``: (sid, n, SKETCH, tokens) to ROWS, a row for each of the rarest words of the set."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sid, n, *sketch = (rb.column(i).to_numpy() for i in range(2 + len(SKETCH)))
            t = rb.column(2 + len(SKETCH)).flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            h = _token_hash(t)
            order = np.lexsort((h, _logs(t, heavy, logs, floor), owner))
            rank = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            keep = rank < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
            row = owner[keep]
            yield pa.RecordBatch.from_arrays([pa.array(B.mix(h[order][keep] ^ U(0x7F4A7C15)).view(np.int64)), pa.array(sid[row]), *(pa.array(x[row]) for x in sketch)], ["path", "sid", *SKETCH])

    return split


def tolerance(threshold: float, bits: int = 64 * len(SKETCH)) -> int:
    """Bits in which two sketches may differ: agreeing bits have mean (1 + J) / 2; four standard deviations of slack lose about one pair in 30,000."""
    agree = (1 + threshold) / 2
    return math.ceil(bits * (1 - agree + 4 * math.sqrt(agree * (1 - agree) / bits)))


def _bits(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Bits in which two sketches differ (counted on unsigned words)."""
    out = np.bitwise_count((a[0] ^ b[0]).view(U)).astype(np.int16)
    for x, y in zip(a[1:], b[1:]):
        out += np.bitwise_count((x ^ y).view(U))
    return out


def _pairs_of(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """Distinct pairs, the smaller id first."""
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return [pa.array(p[0]), pa.array(p[1])]


def compare(differ: int, large: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over ROWS sorted by path, to FOUND: pairs with close sketches, and members of other buckets.

    A pair is a row (sid_a, sid_b). The members of a bucket over ``large`` come as rows (path, over = true, sids), those of
    a bucket with too many close pairs as (path, over = false, sids). A task holds one batch and ``large`` records at most.
    """
    names = ["sid_a", "sid_b", "path", "over", "sids"]

    def members(path: np.ndarray, sid: np.ndarray, over: bool) -> pa.RecordBatch:
        none, one = pa.array([None], pa.int64()), pa.array([0, len(sid)], pa.int32())
        return pa.RecordBatch.from_arrays([none, none, pa.array(path[:1]), pa.array([over]), pa.ListArray.from_arrays(one, pa.array(sid))], names)

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, a)):
            x = _pairs_of(np.concatenate(a), np.concatenate(b))
            n = len(x[0])
            yield pa.RecordBatch.from_arrays([*x, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.list_(pa.int64()))], names)

    def wide(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """One bucket, some records against all of it at a time; given up as soon as it is dense."""
        path, sid, *sketch = rows
        a, b, found = [], [], 0
        for lo in range(0, len(sid), 128):
            near = _bits([x[lo : lo + 128, None] for x in sketch], [x[None, lo:] for x in sketch]) <= differ
            i, j = np.nonzero(near & (sid[lo : lo + 128, None] != sid[None, lo:]))
            a.append(sid[lo + i])
            b.append(sid[lo + j])
            found += len(i)
            if found > DENSE * len(sid):
                yield members(path, sid, False)
                return
        yield from pairs(a, b)

    def close(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        path = rows[0]
        if not len(path):
            return
        edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        size = np.diff(edge)
        for k in np.flatnonzero(size > WIDE):
            yield from wide([x[edge[k] : edge[k + 1]] for x in rows])
        keep = np.repeat(size <= WIDE, size)
        path, sid, *sketch = (x[keep] for x in rows)
        if not len(path):
            return
        edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        last = np.repeat(edge[1:] - 1, np.diff(edge))
        i, d, a, b = np.arange(len(path)), 1, [], []
        while len(i := i[last[i] >= i + d]):
            j = i + d
            near = (_bits([x[i] for x in sketch], [x[j] for x in sketch]) <= differ) & (sid[i] != sid[j])
            a.append(sid[i[near]])
            b.append(sid[j[near]])
            d += 1
        yield from pairs(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(2 + len(SKETCH))]
        split = None  # the bucket over ``large`` that is streaming by
        for rb in batches:
            if not rb.num_rows:
                continue
            rows = [np.concatenate([k, rb.column(i).to_numpy()]) for i, k in enumerate(kept)]
            path = rows[0]
            edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
            size = np.diff(edge)
            normal = np.ones(len(path), bool)
            start = int(edge[-2])  # the last bucket may go on in the next batch
            normal[start:] = False
            for a, n in zip(edge[:-1].tolist(), size.tolist()):
                if n > large or path[a] == split:
                    split = path[a]
                    normal[a : a + n] = False
                    for at in range(a, a + n, large):
                        yield members(path[a : a + 1], rows[1][at : min(at + large, a + n)], True)
                    if a == start:
                        start = a + n
            yield from close([x[normal] for x in rows])
            kept = [x[start:] for x in rows]
        if len(kept[0]):
            yield from close(kept)

    return run


FOUND = "sid_a bigint, sid_b bigint, path bigint, over boolean, sids array<bigint>"


def _exact(threshold: float):
    """(same, sids and tokens of a block, those of another) to the pairs at the threshold: a product of word matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k in range(rb.num_rows):
                (sa, ta), (sb, tb) = ((u.field("sid").to_numpy(), u.field("tokens")) for u in (rb.column(c)[k].values for c in (0, 1)))
                na, nb = (np.diff(t.offsets.to_numpy()) for t in (ta, tb))
                fa, fb = (t.flatten().to_numpy() for t in (ta, tb))
                ra, rb_ = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
                both = np.intersect1d(fa, fb)  # words that only one block has are common to no pair
                common = np.zeros((len(na), len(nb)), np.float32)
                for lo in range(0, len(both), 4_096):
                    part = both[lo : lo + 4_096]
                    m = []
                    for f, r, n in ((fa, ra, len(na)), (fb, rb_, len(nb))):
                        at = np.minimum(np.searchsorted(part, f), len(part) - 1)
                        hit = part[at] == f
                        x = np.zeros((n, len(part)), np.float32)
                        x[r[hit], at[hit]] = 1
                        m.append(x)
                    common += m[0] @ m[1].T
                near = common >= (threshold - 1e-6) * (na[:, None] + nb[None, :] - common)
                i, j = np.nonzero(near & (sa[:, None] != sb[None, :]))
                yield pa.RecordBatch.from_arrays(_pairs_of(sa[i], sb[j]), ["sid_a", "sid_b"])

    return run


def _exact_pairs(groups: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """Pairs within each bucket of ``groups(path, sids)``, as pairs of blocks; a bucket's members are never in one task."""
    rows = groups.select("path", F.explode("sids").alias("sid")).distinct()
    n = rows.groupBy("path").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    x = rows.join(n, "path").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("n")).cast("int")).select("path", "sid", "block")
    u = x.join(one.select("sid", "tokens"), "sid").groupBy("path", "block").agg(F.collect_list(F.struct("sid", "tokens")).alias("u"))  # about BLOCK records
    u = written(u, "blocks")
    at = n.select("path", F.col("n").cast("int").alias("n")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("q", F.explode(F.sequence(F.col("p"), F.col("n") - 1)))
    side = lambda c: u.select("path", F.col("block").alias(c), F.col("u").alias(f"u_{c}"))
    both = at.select("path", "p", "q").join(side("p"), ["path", "p"]).join(side("q"), ["path", "q"])
    return both.repartition("path", "p", "q").select("u_p", "u_q").mapInArrow(_exact(threshold), "sid_a bigint, sid_b bigint")


def _bucketed(rows: DataFrame, differ: int, large: int, name: str) -> DataFrame:
    return written(rows.repartition("path").sortWithinPartitions("path").mapInArrow(compare(differ, large), FOUND), name)


def class_pairs(sets: DataFrame, threshold: float = 0.8, runs: int | None = None, bucket: int | None = None) -> DataFrame:
    """``(sid_a, sid_b, larger, sim)`` of distinct sets with Jaccard >= ``threshold``; ``sets`` must be a written table.

    Without ``runs`` there are as many as RECALL takes.
    """
    bucket = bucket or BUCKET
    one = bodies(sets)
    n_records, mean_size = one.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    heavy, logs, floor = frequent_tokens(one, n_records, mean_size)
    runs = runs or runs_needed(logs, floor, n_records, mean_size, bucket)
    source, differ = one.select("sid", "n", *SKETCH, "tokens"), tolerance(threshold)
    found = _bucketed(source.mapInArrow(paths(heavy, logs, floor, n_records, threshold, runs, bucket), ROWS), differ, LARGE, "buckets")
    parts, groups = [found.filter("sids is null").select("sid_a", "sid_b")], found.filter("not over").select("path", "sids")
    if found.filter("over").limit(1).count():
        over = found.filter("over").select(F.explode("sids").alias("sid")).distinct()
        again = _bucketed(source.join(small(over, BROADCAST_KEYS), "sid", "left_semi").mapInArrow(rarest(heavy, logs, floor, threshold), ROWS), differ, LARGE, "split")
        parts.append(again.filter("sids is null").select("sid_a", "sid_b"))
        groups = groups.unionByName(again.filter("sids is not null").select("path", "sids"))
    if groups.limit(1).count():
        parts.append(_exact_pairs(groups, one, threshold))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return verified(written(pairs.distinct(), "pairs"), one, threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a written table) with their larger size and exact Jaccard, at ``threshold`` or above."""
    needed = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).distinct()
    some = sets.join(small(needed, BROADCAST_KEYS), "sid", "left_semi").select("sid", "n", "tokens").dropDuplicates(["sid"])
    a = some.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = some.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    common = F.size(F.array_intersect("t_a", "t_b"))
    j = pairs.join(a, "sid_a").join(b, "sid_b").select("sid_a", "sid_b", F.greatest("n_a", "n_b").alias("larger"), (common / (F.col("n_a") + F.col("n_b") - common)).alias("sim"))
    return j.filter(F.col("sim") >= threshold - 1e-12)


def near_duplicates(df: DataFrame, key: str, text: Column, threshold: float = 0.8, runs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, sid)`` of classes of equal word sets, and ``(sid_a, sid_b, sim)`` between classes.

    Keys are strings; a NULL key, a NULL or word-less text gives no row; rows delivered twice count once; an empty table
    gives two empty results.
    """
    sets = written(word_sets(df.filter(F.col(key).isNotNull()), key, text), "sets")
    return sets.select("key", "sid").distinct(), class_pairs(sets, threshold, runs)


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of keys, the smaller first, from classes and links between classes."""
    a, b = (members.select(F.col("key").alias(f"key_{x}"), F.col("sid").alias(f"sid_{x}")) for x in "ab")
    between = pairs.select("sid_a", "sid_b").join(a, "sid_a").join(b, "sid_b")
    within = a.join(b, F.col("sid_a") == F.col("sid_b")).filter("key_a < key_b")
    ab = between.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    return ab.unionByName(within.select("key_a", "key_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(key, class_key, group_key, n_links)`` of every record.

    ``class_key`` is the least key with the same set of words, ``group_key`` the least that is reached over links;
    ``n_links`` counts the other records of the class and the records of the linked classes.
    """
    links = written(pairs.select("sid_a", "sid_b"), "links")
    both = links.unionByName(links.select(F.col("sid_b").alias("sid_a"), F.col("sid_a").alias("sid_b")))
    size = members.groupBy("sid").agg(F.count("*").alias("size"), F.min("key").alias("class_key"))
    other = both.join(size.select(F.col("sid").alias("sid_b"), "size"), "sid_b").groupBy(F.col("sid_a").alias("sid")).agg(F.sum("size").alias("others"))
    roots = components(links, "sid_a", "sid_b").select(F.col("node").alias("sid"), "root").join(size.select("sid", "class_key"), "sid")
    least = roots.groupBy("root").agg(F.min("class_key").alias("group_key"))
    reached = roots.select("sid", "root").join(least, "root").select("sid", "group_key")
    out = members.join(size, "sid").join(other, "sid", "left").join(reached, "sid", "left")
    return out.select("key", "class_key", F.coalesce("group_key", "class_key").alias("group_key"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
