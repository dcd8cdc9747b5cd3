"""Connected components of links, and order along rings, in rounds of joins that halve what is left.

Every round goes to a table in the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwake.sources.scratch import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """``links`` (``u``, ``v``: comparable ids) to ``node``, ``label``: the smallest id that a linked node can reach.

    Alternating large-star and small-star steps.  A large step links each node's larger neighbours to its smallest one, a
    small step a node and its smaller neighbours to the smallest of them; the number of rounds is at most in the order
    of the square of the logarithm of the number of nodes, and about its logarithm in practice, however long a chain
    is.  Links never become more than there are.  Links of a node to itself are ignored; nodes without links do not
    appear.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while before != (now := _state(edges)):
        before = now
        if not now[0]:
            break
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(floor, large["u"] == floor["w"]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        edges = stored(small.union(floor.select("w", "m")).distinct(), "links")
    roots = edges.select("v").distinct()
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))


def ring_places(nodes: DataFrame, counts: Column) -> DataFrame:
    """Nodes of closed rings (``id``, ``next``) with ``ring``, the smallest id of the ring, and ``ahead``: how many of the nodes
    for which ``counts`` holds stand from this one on, before the ring's smallest.

    List ranking by pointer doubling: after round k a node knows the smallest id among the next 2^k nodes, what is counted
    up to there, and the node after them; a round is one join, and the rounds are the logarithm of the longest ring, plus
    one that finds nothing new.
    """
    one = F.when(counts, 1).otherwise(0).cast("long")
    state = stored(nodes.select("id", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead"), one.alias("passed"), F.lit(True).alias("new")), "ring")
    while True:
        other = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"), F.col("passed").alias("_passed"))
        nearer = F.col("_ring") < F.col("ring")
        state = stored(
            state.join(other, F.col("jump") == F.col("_id")).select(
                "id",
                F.col("_jump").alias("jump"),
                F.least("ring", "_ring").alias("ring"),
                F.when(nearer, F.col("passed") + F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"),
                (F.col("passed") + F.col("_passed")).alias("passed"),
                nearer.alias("new"),
            ),
            "ring",
        )
        if state.where("new").isEmpty():
            return state.select("id", "ring", "ahead")
