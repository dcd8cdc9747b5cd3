"""Links from lists of members that may be alike, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwake.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """``links`` (``u``, ``v``: comparable ids) to ``node``, ``label``: the smallest id that a linked node can reach.

    Alternating large-star and small-star steps: each is one aggregation and one join over the links, which never
    become more than there are, and every round goes to the shared folder, so that lineage stays short.  Links of a
    node to itself are ignored; nodes without links do not appear.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
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
        edges = materialize(small.union(floor.select("w", "m")).distinct(), "links")
    roots = edges.select("v").distinct()
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))


def _blocks(lists: DataFrame, block: int) -> DataFrame:
    """Pairs in lists (``list, m, id, label``) that no label joins yet; large lists meet in pairs of blocks."""
    rows = cells(lists, block).select("list", "i", "j", "own", "id", "label")
    a, b = rows.toDF("list", "i", "j", "own", "u", "label"), rows.toDF("list", "i", "j", "own2", "v", "label2")
    return a.join(b, ["list", "i", "j"]).where("u < v AND label <> label2 AND (own <> own2 OR i = j)").select("u", "v").distinct()


def cells(lists: DataFrame, block: int) -> DataFrame:
    """Lists (``list, m, id``) as pairs of blocks: each member, with its own block ``own``, once for each cell ``i, j`` that it is in."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    return lists.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("cell", F.explode(each)).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")}).drop("cell")


def links_of_lists(lists: DataFrame, verify: Callable[[DataFrame], DataFrame], dense: int = 64, block: int = 512, pairs: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Links ``u, v`` that give all members of each list (``list``, ``id``) that are alike the same component.

    ``verify`` keeps the pairs (``u, v``) that are alike.  Lists of more than ``dense`` members are compared with two of
    them first: one by chance, and the one that shares the most long lists with others, as the text does that copies
    were made from.  What that links needs no further comparison.  The others are compared pair by pair, in blocks, so
    nothing is left out, and a large group of near copies costs rows in proportion.  ``pairs`` makes the pairs (``u, v``)
    of ``list, m, id, label`` (and what else ``lists`` has) that no label joins and that are worth verifying; all by default.
    """
    lists = materialize(lists.join(lists.groupBy("list").agg(F.count("*").alias("m")).where("m > 1"), "list"), "lists")
    links, todo = None, lists.withColumn("label", F.col("id"))
    crowd = lists.where(F.col("m") > dense)
    if not crowd.isEmpty():
        # a text that many others were made from shares more long lists with them than they share with each other
        weights = crowd.groupBy("id").agg(F.sum("m").alias("weight"))
        weighed = materialize(crowd.join(weights, "id").select("list", "id", "weight"), "weighed")
        heads = weighed.groupBy("list").agg(F.array(F.max_by("id", F.struct("weight", "id")), F.min_by("id", F.xxhash64("list", "id"))).alias("heads"))
        met = weighed.select("list", "id").join(heads, "list").select("id", F.explode("heads").alias("o")).where("id <> o")
        links = materialize(verify(met.select(F.least("id", "o").alias("u"), F.greatest("id", "o").alias("v")).distinct()), "star_links")
        labels = components(links).withColumnRenamed("node", "id")
        todo = materialize(lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "todo")
        apart = todo.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("list")
        todo = todo.join(apart, "list", "left_semi")
    found = verify((pairs or _blocks)(todo, block))
    return found if links is None else links.union(found)
