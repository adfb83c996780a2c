"""Splits that keep related records together.

Related records are connected components over shared keys (distinct key pairs only, so copies cost nothing). Components
are laid into equal bins by largest differencing: every shard of components combines the two most uneven partial
layouts, the heavy bins of one on the light bins of the other, until one layout is left; layouts of shards are then
items of the next level. Whole bins go to splits by target proportion, the heaviest first to the split that lacks most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from syllaweave.operators.graph import components
from syllaweave.session import written

#: Bins of a layout, and components (or bins of the level below) that one task lays out.
BINS, SHARD = 128, 65_536


def differencing(weights: list[int], bins: int) -> list[int]:
    """Bin of each weight. Largest differencing (Karmarkar and Karp) for ``bins`` equal bins; ties by order."""
    if not weights:
        return []
    # a layout: its bins from light to heavy as (weight, members); only bins that hold something are kept
    heap = [(-w, i, [(w, [i])]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        if len(x) < len(y):
            x, y = y, x
        room = bins - len(x)
        y = sorted(y, key=lambda b: -b[0])
        # the heavy bins of one on the light (or empty) bins of the other
        free, rest = y[:room], y[room:]
        joined = [(bx[0] + by[0], bx[1] + by[1] if len(bx[1]) >= len(by[1]) else by[1] + bx[1]) for bx, by in zip(x, rest)] + x[len(rest):] + free
        joined.sort(key=lambda b: b[0])
        low = joined[0][0] if len(joined) == bins else 0
        heapq.heappush(heap, (low - joined[-1][0], made, joined))
        made += 1
    out = [0] * len(weights)
    for k, (_, members) in enumerate(sorted(heap[0][2], key=lambda b: -b[0])):
        for i in members:
            out[i] = k
    return out


def _lay_out(bins: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["weight", "item"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"item": shard["item"], "shard": shard["shard"], "bin": differencing(shard["weight"].astype(int).tolist(), bins), "weight": shard["weight"]})

    return run


def balanced_bins(items: DataFrame, bins: int = BINS, shard: int = SHARD) -> DataFrame:
    """``(item, bin)`` for ``items(item string, weight bigint)``: about equal bins, whole items."""
    level = items.select(F.col("item").cast("string").alias("item"), F.col("weight").cast("bigint").alias("weight"))
    n = level.count()
    chain: list[DataFrame] = []
    while True:
        shards = max(1, -(-n // shard))
        cut = level.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        laid = written(cut.groupBy("shard").applyInPandas(_lay_out(bins), "item string, shard bigint, bin int, weight bigint"), "bins")
        chain.append(laid)
        if shards == 1:
            break
        level = laid.groupBy(F.concat_ws(":", "shard", "bin").alias("item")).agg(F.sum("weight").alias("weight"))
        n = min(shards * bins, n)
    out = chain[0].select("item", F.concat_ws(":", "shard", "bin").alias("up"))
    for upper in chain[1:]:
        out = out.join(upper.select(F.col("item").alias("up"), F.concat_ws(":", "shard", "bin").alias("next")), "up").select("item", F.col("next").alias("up"))
    return out.select("item", F.substring_index("up", ":", -1).cast("int").alias("bin"))


def bin_splits(weights: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Split of each ``(bin, weight)``: the heaviest bin first, to the split that lacks most of its target."""
    total = sum(w for _, w in weights)
    lack = {s: p * total for s, p in shares.items()}
    out = {}
    for b, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        s = max(lack, key=lambda k: lack[k])
        out[b] = s
        lack[s] -= w
    return out


def related(df: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """``(key, first, second, root)``: rows with an equal ``first`` or an equal ``second``, directly or over others, share ``root``.

    NULL and empty keys connect nothing; a row without both is alone; rows with an equal ``key`` share ``root`` too.
    """
    null = F.lit(None).cast("string")
    clean = df.select(F.col(key).alias("key"), first.alias("first"), second.alias("second"))
    clean = clean.select("key", F.when(F.col("first") != "", F.concat(F.lit("k"), "first")).otherwise(null).alias("first"), F.when(F.col("second") != "", F.concat(F.lit("c"), "second")).otherwise(null).alias("second")).distinct()
    node = F.coalesce("first", "second", F.concat(F.lit("i"), "key"))
    # a key with several rows joins their groups
    several = clean.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    across = clean.join(several, "key", "left_semi").select(F.concat(F.lit("i"), "key").alias("first"), node.alias("second"))
    roots = components(clean.select("first", "second").unionByName(across), "first", "second")
    out = clean.withColumn("node", node).join(roots, "node", "left")
    return out.select("key", F.substring("first", 2, 1 << 20).alias("first"), F.substring("second", 2, 1 << 20).alias("second"), F.coalesce("root", "node").alias("root"))


def assign(df: DataFrame, key: str, first: Column, second: Column, shares: dict[str, float]) -> DataFrame:
    """``(key, group, group_code, split)`` for each key; ``group_code`` is the least ``second`` of the group or NULL.

    Rows with an equal key are one record and come into one split. An empty table gives no rows.
    """
    rows = written(related(df, key, first, second), "related")
    groups = rows.groupBy("root").agg(F.countDistinct("key").alias("weight"), F.min("second").alias("group_code"))
    groups = written(groups, "groups")
    bins = balanced_bins(groups.select(F.col("root").alias("item"), "weight"))
    laid = written(groups.join(bins, groups["root"] == bins["item"]).select("root", "group_code", "weight", "bin"), "laid")
    weights = [tuple(r) for r in laid.groupBy("bin").agg(F.sum("weight")).collect()]  # at most BINS rows
    chosen = bin_splits(weights, shares)
    split = F.lit(None).cast("string")
    for s in shares:
        split = F.when(F.col("bin").isin([b for b, v in chosen.items() if v == s]), F.lit(s)).otherwise(split)
    return rows.join(laid, "root").select("key", F.col("root").alias("group"), "group_code", split.alias("split")).distinct()
