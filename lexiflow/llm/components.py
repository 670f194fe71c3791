"""Connected components with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum, one row on the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its partners.

    The minimum is combined before the shuffle, so a hub with any number of partners is cheap; the join back on a
    hub is one that adaptive execution can split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the least node that it can reach.

    Alternates large-star steps (larger partners of a node move to the node's minimum) with small-star steps (a node
    and its smaller partners move to the minimum) until the edges stay as they are, which they do when each
    component is a star around its least node. Rounds grow with the logarithm of the longest path. Each round is
    a written table, so no plan grows and a lost executor costs one round. Edges with a null end, self-loops and
    repeated edges have no effect except that a self-loop names its node; an empty input gives an empty result.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = both.where("a = b").select(F.col("a").alias("node")).distinct()
    now = staged(both.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(mirrored).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_minimum(large)
        past, now = now, staged(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        after = _state(now)
        discard(past)  # what follows reads the new table only
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = found.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
