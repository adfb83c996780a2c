"""Connected components by alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from syllaweave.session import drop_written, written


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the least node of its component.

    Works for any orderable node type. Edges with a NULL end and loops are ignored; repeated edges count once. Each
    round is two aggregations over node keys (never a list of a node's neighbours), so a node with a third of all edges
    is only a hot key of a map-side combined ``min``. The number of rounds grows with the logarithm of the diameter.
    """
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    e = edges.select(u, v).filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the least of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(star, "edges")
        same = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_written(e)
        e = nxt
        if before == same:
            break
        before = same
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
