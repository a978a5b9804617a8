"""Connected components by alternating large-star and small-star rounds, all of them joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import stash


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: each node of an edge, with the smallest node reachable from it.

    Loops, repeated edges and edges holding a null are allowed and add nothing. Every round works on grouped minima
    that are combined before the shuffle; where they meet a hub's links again, the links are salted, so a hub with
    many neighbours never meets in one task. Rounds end when no edge changes; each round is written to the shared folder.
    """
    links = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v and a is not null and b is not null").distinct(), "links")
    before = None
    while (now := _state(links)) != before and now[0]:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _with_least(large, least)
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = stash(small.where("u > v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


#: Groups into which the links of a node are dealt where they meet its least neighbour.
SALTS = 4


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    salted = least.select(F.col("u").alias("s_u"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return links.join(salted, (links.u == salted.s_u) & (F.pmod(F.xxhash64("v"), F.lit(SALTS)) == salted.salt)).select("u", "v", "m")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
