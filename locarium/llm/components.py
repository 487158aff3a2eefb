"""Connected components by alternating stars, each half round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

#: An id that has more than about one in so many of the edges is hot; there are fewer than three times so many such ids, in any table.
SHARE = 1024


def _with_least(edges: DataFrame, key: str, about: DataFrame, total: int) -> DataFrame:
    """The edges with the m of their key, from about (key, m, and ``of``, the key's number of edges).
    The edges of a hot key, which would meet in one task, stay where they are, and its m is sent to them."""
    hot = F.broadcast(about.where(F.col("of") * SHARE > total).select(key, "m"))
    cold = edges.join(hot, key, "left_anti").join(about.select(key, "m"), key)
    return cold.unionByName(edges.join(hot, key))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id of the edges (columns a, b): component is its smallest
    reachable id, itself included; an id that reaches no smaller one isn't listed.

    Large-star links every larger neighbour to the smallest one, small-star every
    smaller neighbour; the rounds end when a round changes nothing, after about
    log(n) of them. Loops, repeated edges and null ends don't matter. Edges stay in
    tables; a round sends two numbers to the driver. The centre of a star, which may have
    most of the edges, doesn't gather them: see :func:`_with_least`.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("x")).first()
        if state == before or not state["n"]:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # every edge stands in it twice; as a power of two, so that rounds of like size share compiled code
        total = 1 << (2 * state["n"]).bit_length() - 1
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("of")).select("u", F.least("u", "m").alias("m"), "of")
        large = _with_least(both.where("v > u"), "u", least, total).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # what u itself keeps: its edge to the smallest
        large = scratch.keep(large.unionByName(least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("of"))
        small = _with_least(large, "hi", smallest, total).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        done, now = now, scratch.keep(small.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct())
        scratch.drop(done, large)
        before = state
