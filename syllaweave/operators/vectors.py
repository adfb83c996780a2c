"""Vector similarity between the units of records, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.operators.graph import components
from syllaweave.session import written

#: Vectors in one block; a task holds two blocks and their product.
BLOCK = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def blocks(df: DataFrame, group: str, owner: str, ix: str, vec: str, size: int = BLOCK) -> DataFrame:
    """``(group, block, owners, ixs, vecs)``: each group's vectors in blocks of about ``size``, whatever the group's size."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    x = df.join(n, group).withColumn("block", F.pmod(F.xxhash64(ix), F.ceil(F.col("_n") / size)))
    return x.groupBy(group, "block").agg(F.sort_array(F.collect_list(F.struct(F.col(ix).alias("ix"), F.col(owner).alias("owner"), F.col(vec).cast("array<double>").alias("vec")))).alias("u"))


def _block_pairs(x: DataFrame, y: DataFrame, group: str, ordered: bool) -> DataFrame:
    """``(g, same, ua, ub)``: the blocks of two tables to be multiplied, spread over tasks by group and both block numbers.

    Only block numbers meet on the group; the vectors join by (group, block), so a group of any size is no hot key.
    """
    n = lambda df, c: df.groupBy(group).agg((F.max("block") + 1).alias(c))
    at = n(x, "_n").join(n(y, "_m"), group).withColumn("p", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    low = F.col("p") if ordered else F.lit(0)
    at = at.filter(low <= F.col("_m") - 1).withColumn("q", F.explode(F.sequence(low, (F.col("_m") - 1).cast("int")))).select(group, "p", "q")
    left = x.select(group, F.col("block").cast("int").alias("p"), F.col("u").alias("ua"))
    right = y.select(group, F.col("block").cast("int").alias("q"), F.col("u").alias("ub"))
    both = at.join(left, [group, "p"]).join(right, [group, "q"])
    return both.select(F.col(group).cast("bigint").alias("g"), (F.col("p") == F.col("q")).alias("same"), "ua", "ub")


def _opened(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, owners and vectors of a block."""
    u = block.values
    return u.field("ix").to_numpy(zero_copy_only=False), u.field("owner").to_numpy(zero_copy_only=False), np.stack(u.field("vec").to_numpy(zero_copy_only=False))


def _products(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for g, same, a, b in zip(*(rb.column(i) for i in range(4))):
                (ia, oa, va), (ib, ob, vb) = _opened(a), _opened(b)
                s = va @ vb.T
                keep = (oa[:, None] != ob[None, :]) & (s >= threshold)
                if same.as_py():
                    keep &= ia[:, None] < ib[None, :]
                i, j = np.nonzero(keep)
                swap = (oa[i] > ob[j]) | ((oa[i] == ob[j]) & (ia[i] > ib[j]))
                x = lambda p, q, swap=swap: np.where(swap, q, p)
                cols = [pa.array([g.as_py()] * len(i), g.type), pa.array(x(oa[i], ob[j])), pa.array(x(ob[j], oa[i])), pa.array(x(ia[i], ib[j])), pa.array(x(ib[j], ia[i])), pa.array(s[i, j])]
                yield pa.RecordBatch.from_arrays(cols, ["group", "owner_a", "owner_b", "ix_a", "ix_b", "sim"])

    return run


def unit_pairs(df: DataFrame, group: str, owner: str, ix: str, vec: str, threshold: float) -> DataFrame:
    """``(group, owner_a, owner_b, ix_a, ix_b, sim)`` of similar units of different owners in one group, each pair once.

    ``group``, ``owner`` and ``ix`` are BIGINT. Owners without such a partner in the group give no row.
    """
    b = blocks(df, group, owner, ix, vec)
    return _block_pairs(b, b, group, True).mapInArrow(_products(threshold), "group bigint, owner_a bigint, owner_b bigint, ix_a bigint, ix_b bigint, sim double")


BEST = "group bigint, owner bigint, ix bigint, other bigint, other_ix bigint, sim double"


def _best(k: int, mirrored: bool):
    """Block products reduced to the ``k`` best units of each other owner for every unit, before anything leaves the task."""

    def side(g, i, o, s, other_i, other_o, own: bool):  # noqa: ANN001, ANN202
        order = np.lexsort((other_i, other_o))
        s, oi, oo = s[:, order], other_i[order], other_o[order]
        edge = np.flatnonzero(np.concatenate([[True], oo[1:] != oo[:-1], [True]]))
        out = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            part = s[:, lo:hi]
            top = part.argmax(1)[:, None] if k == 1 else np.argsort(-part, axis=1, kind="stable")[:, :k]
            rows = np.flatnonzero(o != oo[lo]) if own else np.arange(len(o))
            r = np.repeat(rows, top.shape[1])
            c = top[rows].ravel()
            out.append((o[r], i[r], np.full(len(r), oo[lo]), oi[lo + c], part[r, c]))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), g.as_py())), *map(pa.array, cols)], ["group", "owner", "ix", "other", "other_ix", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for g, same, a, b in zip(*(rb.column(i) for i in range(4))):
                (ia, oa, va), (ib, ob, vb) = _opened(a), _opened(b)
                s = va @ vb.T
                yield side(g, ia, oa, s, ib, ob, mirrored)
                if mirrored and not same.as_py():
                    yield side(g, ib, ob, s.T, ia, oa, True)

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    if k == 1:
        best = F.max_by(F.struct("other_ix", "sim"), F.struct("sim", -F.col("other_ix")))
        return parts.groupBy("group", "owner", "ix", "other").agg(best.alias("b")).select("group", "owner", "ix", "other", "b.other_ix", "b.sim")
    w = Window.partitionBy("group", "owner", "ix", "other").orderBy(F.desc("sim"), "other_ix")
    return parts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def unit_best(df: DataFrame, group: str, owner: str, ix: str, vec: str) -> DataFrame:
    """BEST: for every unit its most similar unit of each other owner of the group (ties: the smaller number)."""
    b = blocks(df, group, owner, ix, vec)
    return _merged(_block_pairs(b, b, group, True).mapInArrow(_best(1, True), BEST), 1)


def nearest(queries: DataFrame, items: DataFrame, group: str, query: str, bucket: str, ix: str, vec: str, k: int = 1) -> DataFrame:
    """``(group, query, bucket, ix, sim)``: the ``k`` most similar items of each bucket of the query's group.

    ``queries`` has ``group, query, vec`` and ``items`` ``group, bucket, ix, vec``, all keys BIGINT. Both sides are blocks
    of matrix products, so neither is collected; a query of a group without items gives no row.
    """
    a = blocks(queries.withColumn("_o", F.lit(0).cast("bigint")), group, "_o", query, vec)
    parts = _block_pairs(a, blocks(items, group, bucket, ix, vec), group, False).mapInArrow(_best(k, False), BEST)
    return _merged(parts, k).select(F.col("group").alias(group), F.col("ix").alias(query), F.col("other").alias(bucket), F.col("other_ix").alias("ix"), "sim")


def maxsim(best: DataFrame, tau: float) -> DataFrame:
    """Coverage of either owner's units, overlap (F measure), soft similarity and largest similarity of each owner pair of :func:`unit_best`."""
    by = ["group", "owner_a", "owner_b"]
    side = lambda a, b: best.filter(F.col(a) < F.col(b)).groupBy("group", F.col(a).alias("owner_a"), F.col(b).alias("owner_b"))
    cov = F.avg((F.col("sim") >= tau).cast("double"))
    a = side("owner", "other").agg(cov.alias("cov_a"), F.avg("sim").alias("mean_a"), F.max("sim").alias("max_unit"))
    b = side("other", "owner").agg(cov.alias("cov_b"), F.avg("sim").alias("mean_b"))
    f = F.when(F.col("cov_a") + F.col("cov_b") > 0, 2 * F.col("cov_a") * F.col("cov_b") / (F.col("cov_a") + F.col("cov_b"))).otherwise(0.0)
    return a.join(b, by).select(*by, "cov_a", "cov_b", f.alias("overlap"), ((F.col("mean_a") + F.col("mean_b")) / 2).alias("soft"), "max_unit")


def mean_pool(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """``(*keys, vec)``: the mean vector over its norm."""
    dims = df.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = dims.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return v.withColumn("_norm", norm).withColumn("vec", F.transform("vec", lambda x: x / F.col("_norm"))).drop("_norm")


def best_unit_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The best unit pair of each owner pair, and of those the ``k`` most similar."""
    w = Window.partitionBy("group", "owner_a", "owner_b").orderBy(F.desc("sim"), "ix_a", "ix_b")
    one = pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return one.orderBy(F.desc("sim"), "group", "ix_a", "ix_b").limit(k)


def shared_units(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(root, ix)`` of units linked over pairs of different owners; only groups of two owners or more."""
    roots = written(components(pairs, "ix_a", "ix_b"), "roots").select(F.col("node").alias("ix"), "root")
    x = roots.join(members, "ix")
    n = x.groupBy("root").agg(F.countDistinct("owner").alias("owners")).filter("owners >= 2")
    return x.join(n, "root")


def average_ranks(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """Adds the average rank of ``score`` within ``by``, divided by the number of rows."""
    every, peers = Window.partitionBy(*by), Window.partitionBy(*by, score)
    return df.withColumn(out, (F.rank().over(Window.partitionBy(*by).orderBy(score)) + (F.count("*").over(peers) - 1) / 2) / F.count("*").over(every))


def empirical_cdf(df: DataFrame, score: str, reference: DataFrame, out: str, most: int = 10_000) -> DataFrame:
    """Adds the share of ``reference`` (one DOUBLE column) that is not above the score; 0 without a reference.

    Up to ``most`` values the sorted list is broadcast. A longer one is counted by distinct values first: scores and
    values are sorted into ranges together, and counts add up over ranges and within each.
    """
    c = reference.columns[0]
    ref = reference.select(F.col(c).cast("double").alias("_v")).filter("_v is not null")
    if ref.limit(most + 1).count() <= most:
        listed = ref.agg(F.array_sort(F.collect_list("_v")).alias("_ref"))  # bounded just above
        return df.crossJoin(F.broadcast(listed)).withColumn(out, F.size(F.filter("_ref", lambda r: r <= F.col(score))) / F.greatest(F.size("_ref"), F.lit(1))).drop("_ref")
    values = ref.groupBy("_v").agg(F.count("*").alias("_c")).unionByName(df.select(F.col(score).cast("double").alias("_v")).distinct().withColumn("_c", F.lit(0).cast("bigint")))
    points = values.groupBy("_v").agg(F.sum("_c").alias("_c"))
    cuts = points.approxQuantile("_v", [i / 64 for i in range(1, 64)], 0.005)  # 63 borders
    part = sum(((F.col("_v") > x).cast("int") for x in sorted(set(cuts))), F.lit(0))
    ranged = written(points.withColumn("_p", part), "points")
    before = ranged.groupBy("_p").agg(F.sum("_c").alias("_s")).withColumn("_before", F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # 64 rows
    total = ranged.agg(F.sum("_c").alias("_t"))
    w = Window.partitionBy("_p").orderBy("_v")
    share = (F.coalesce("_before", F.lit(0)) + F.sum("_c").over(w)) / F.greatest("_t", F.lit(1))
    found = ranged.join(F.broadcast(before.select("_p", "_before")), "_p").crossJoin(F.broadcast(total)).select("_v", share.alias(out))
    return df.join(found, F.col(score).cast("double") == F.col("_v"), "left").drop("_v")


def logistic(features: dict[str, tuple[float, float, float]], intercept: float) -> Column:
    """Probability of a frozen model: ``{column: (mean, scale, coefficient)}`` on standardised columns."""
    z = F.lit(intercept)
    for c, (mean, scale, coefficient) in features.items():
        z = z + F.lit(coefficient) * (F.col(c) - mean) / scale
    return F.lit(1.0) / (1 + F.exp(-z))
