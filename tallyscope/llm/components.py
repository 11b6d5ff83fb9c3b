"""Connected components of a table of links, in rounds that each shorten all paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.session import cut


#: Tasks that the links of one node are dealt to.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of u."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["u", "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reached) of every id in ``links`` (columns a, b; any order).

    Each round joins every larger neighbour of a node to its smallest neighbour, then every
    smaller one; stars around the component's smallest id are left, after about log n rounds. A
    node's smallest neighbour is a partial aggregation, and the links of a hub meet it in
    ``SALTS`` tasks. Rounds are checkpointed in the shared folder. Ids of no link
    to another id do not appear; null ids link nothing.
    """
    known = links.where("a is not null and b is not null and a <> b")
    edges = cut(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def sign(e: DataFrame):
        # decimals, because sums of 64-bit hashes overflow
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    state = sign(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, smallest).where("v <> m").select(F.col("v").alias("u"),
                                                                 F.col("m").alias("v"))
        edges = cut(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, sign(edges)
        if tuple(last) == tuple(state):
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()


def groups_within(links: DataFrame, hops: int = 4) -> DataFrame:
    """id, component of every id in ``links``: the smallest id within so many links.

    Ids of one group are connected, but a long chain may be several groups. One plan and one
    written result, for steps that only need most of the components.
    """
    known = links.where("a is not null and b is not null and a <> b")
    pairs = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = pairs.select("a", F.col("a").alias("b"))
    edges = cut(pairs.unionByName(loops).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    label = edges.groupBy("u").agg(F.min("v").alias("m"))
    for _ in range(hops - 1):
        label = _with_least(edges, label).groupBy("v").agg(F.min("m").alias("m")).select(
            F.col("v").alias("u"), "m")
    return cut(label.select(F.col("u").alias("id"), F.col("m").alias("component")))
