"""Merkle manifest of a dataset by superblock reduction.

Each row is a leaf, a SHA-256 over its columns.  Leaves of a language stand in the order of ``doc_id``; every ``fanout``
consecutive nodes become one, level by level, until one is left (the subroot), and the subroots become the root in the
same way.  A row's proof is the list of its siblings from its own level to the root.

The tree is made ``depth`` levels at a time.  A node's index divided by ``fanout ** depth`` is its superblock, a group of
bounded size wherever the node stands, so a language with a third of all rows is just more superblocks.  Grouped
Arrow-backed pandas functions collapse a superblock to its root; the roots are the nodes of the next round, until each
tree has one.  Then proofs go down: a superblock meets the proof of its root in a cogroup, and each of its nodes gets its
own lower proof with that upper proof behind it.  No proof is moved but those of superblocks.

Places come from a range sort: each task counts its own rows by language, and the counts of the tasks before it are added.

Defined results: null values are hashed as ``-``; a null ``doc_id`` stands before all others, and is never tampered with;
rows with equal ids stand in the order of their leaves, so repeated rows are leaves of their own next to each other; the
null language is a tree of its own, before the others; an empty text is ``0:``.  Columns that are missing are an error,
further ones are not hashed.  An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, materialize, read_table

FANOUT, DEPTH = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A proof is a list of levels: the digests left of the node, and those right of it, as one string each.
_PROOF = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of ``-`` for null, else of the number of UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said), 256)


def tampered(docs: DataFrame) -> Column:
    """Where 3 divides the checksum of the id, the text's A-Z are lower-cased; elsewhere the text is what it was."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(touched, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, doc_id, leaf and others) with ``index``, the place in the tree from 0, and ``size``, the tree's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for b in batches:
            places = []
            for t in b.column("tree").to_pylist():
                if t != tree:
                    tree, n = t, 0
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "place"])

    by = ["tree", "doc_id", "leaf"]
    dealt = leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    ranges = materialize(arrow_map(dealt, count, f"{schema}, place long"), "placed")
    counts = ranges.groupBy("tree", "range").agg(F.count("*").alias("n"))
    # a row for each language and task that has some of it
    ahead = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return ranges.join(starts, ["tree", "range"]).withColumn("index", F.col("before") + F.col("place")).drop("before", "place", "range")


def _levels(size: int, fanout: int, depth: int) -> int:
    """How many of ``depth`` levels a tree of ``size`` nodes still needs."""
    n = 0
    while size > 1 and n < depth:
        size, n = -(-size // fanout), n + 1
    return n


def collapse(digests: list[str], levels: int, fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of up to ``fanout ** levels`` nodes, and for each of them what stands left and right of it on its way up."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in digests]
    nodes = list(digests)
    for level in range(levels):
        width = fanout**level
        for k, own in enumerate(proofs):
            at = k // width
            first = at - at % fanout
            own.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        nodes = [digest("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def fold(start: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        start = digest(left + start + right)
    return start


def _superblocks(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes of the next round: the roots of the superblocks of (tree, index, size, digest)."""

    def collapse_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        size = int(block["size"].iloc[0])
        root, _ = collapse(block.sort_values("index")["digest"].tolist(), _levels(size, fanout, depth), fanout)
        return pd.DataFrame({"tree": [key[0]], "index": [key[1]], "size": [-(-size // fanout**depth)], "digest": [root]})

    block = F.floor(F.col("index") / F.lit(fanout**depth)).alias("block")
    return nodes.groupBy("tree", block).applyInPandas(collapse_block, "tree string, index long, size long, digest string")


def reduce_trees(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> list[DataFrame]:
    """Rounds of superblocks, from the nodes given to one node for each tree."""
    rounds = [nodes]
    while not rounds[-1].where("size > 1").isEmpty():
        rounds.append(materialize(_superblocks(rounds[-1].select("tree", "index", "size", "digest"), fanout, depth), "superblocks"))
    return rounds


def descend(nodes: DataFrame, above: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``tree, index, proof`` of nodes, from the proofs of their superblocks' roots (``tree, index, proof``)."""

    def down(key: tuple, block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        _, lower = collapse(block["digest"].tolist(), _levels(int(block["size"].iloc[0]), fanout, depth), fanout)
        tail = [(p["left"], p["right"]) for p in upper["proof"].iloc[0]]
        out = [[{"left": a, "right": b} for a, b in own + tail] for own in lower]
        return pd.DataFrame({"tree": key[0], "index": block["index"].to_numpy(), "proof": out})

    own = nodes.select("tree", "index", "size", "digest", F.floor(F.col("index") / F.lit(fanout**depth)).alias("block"))
    of = above.select("tree", F.col("index").alias("block"), "proof")
    return own.groupBy("tree", "block").cogroup(of.groupBy("tree", "block")).applyInPandas(down, f"tree string, index long, proof {_PROOF}")


def proofs_of(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``tree, index, proof`` of the roots of the last superblocks; ``tops`` has the proof of each tree's own root."""
    known = tops.select("tree", F.lit(0).cast("long").alias("index"), "proof")
    for nodes in reversed(rounds[1:-1]):
        known = materialize(descend(nodes, known, fanout, depth), "proofs")
    return known


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row of ``docs``."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null before all values
    original = [F.col(c) for c in COLUMNS]
    changed = [*original[:-1], tampered(docs)]
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(original).alias("leaf"), leaf_digest(changed).alias("seen"))
    leaves = materialize(placed(leaves).withColumn("digest", F.col("leaf")), "leaves")
    lower = reduce_trees(leaves, fanout, depth)
    # the subroots are the leaves of a tree of their own
    tops = lower[-1].select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("leaf"), "digest")
    upper = reduce_trees(placed(tops), fanout, depth)
    top = upper[-1].first()
    root = top["digest"] if top else None
    nothing = F.expr(f"CAST(array() AS {_PROOF})")
    peak = upper[-1].select("tree", nothing.alias("proof"))
    of_tops = peak.withColumn("index", F.lit(0).cast("long")) if len(upper) == 1 else descend(upper[0], proofs_of(upper, peak, fanout, depth), fanout, depth)
    subroots = materialize(of_tops.join(upper[0].select("tree", "index", F.col("leaf").alias("name"), F.col("digest").alias("subroot")), ["tree", "index"]).select(F.col("name").alias("tree"), "subroot", "proof"), "subroots")

    def finish(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        levels = _levels(int(block["size"].iloc[0]), fanout, depth)
        _, own = collapse(block["digest"].tolist(), levels, fanout)
        tail = [(p["left"], p["right"]) for p in above["proof"].iloc[0]]
        whole = [p + tail for p in own]
        return pd.DataFrame(
            {
                "doc_id": block["doc_id"].astype("Int64"),
                "tree": key[0],
                "leaf": block["leaf"],
                "proof_sha256": [digest("".join(a + b for a, b in p)) for p in whole],
                "folded_root": [fold(s, p) for s, p in zip(block["seen"], whole, strict=True)],
            }
        )

    over = proofs_of(lower, subroots, fanout, depth).select("tree", F.col("index").alias("block"), "proof")
    blocks = leaves.withColumn("block", F.floor(F.col("index") / F.lit(fanout**depth)))
    rows = blocks.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInPandas(finish, "doc_id long, tree string, leaf string, proof_sha256 string, folded_root string")
    lang = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30))
    return rows.join(subroots.select("tree", "subroot"), "tree").select(
        "doc_id", lang.alias("lang"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 by a table of 256 made from its polynomial; levels of the tree by recursion, for trees of up to 8^6 leaves.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS t
), d AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN FALSE ELSE xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 3 = 0 END AS touched
  FROM documents, crc_table
), f AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head, text,
    CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen_text
  FROM d
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(seen_text)) || ':' || seen_text, '-')) AS seen FROM f
), leaves AS (
  SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), up AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, tree, pos // 8, n
), subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), topmost AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM topmost WHERE n > 1 GROUP BY level, pos // 8, n
), nodes AS (
  SELECT level, tree, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL
), tops AS (
  SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM topmost WHERE n > 1 GROUP BY ALL
), low AS (
  SELECT r.tree, r.pos AS leaf_at, level, r.pos // CAST(8 ** level AS BIGINT) % 8 AS own, hs
  FROM leaves r JOIN nodes ON nodes.tree = r.tree AND nodes.run = r.pos // CAST(8 ** (level + 1) AS BIGINT)
), high AS (
  SELECT s.tree, 1000 + level AS level, s.pos // CAST(8 ** level AS BIGINT) % 8 AS own, hs
  FROM subroots s JOIN tops ON tops.run = s.pos // CAST(8 ** (level + 1) AS BIGINT)
), steps AS (
  SELECT tree, leaf_at, level, array_to_string(hs[1:own], '') AS a, array_to_string(hs[own + 2:], '') AS b FROM low
  UNION ALL
  SELECT r.tree, r.pos, level, array_to_string(hs[1:own], ''), array_to_string(hs[own + 2:], '') FROM leaves r JOIN high USING (tree)
), paths AS (
  SELECT tree, leaf_at, list(struct_pack(a := a, b := b) ORDER BY level) AS path FROM steps GROUP BY ALL
), whole AS (
  SELECT r.*, coalesce(path, []) AS path FROM leaves r LEFT JOIN paths p ON p.tree = r.tree AND p.leaf_at = r.pos
)
SELECT doc_id, leaf, subroot, h AS root, sha256(array_to_string(list_transform(path, lambda p: p.a || p.b), '')) AS proof_sha256,
  list_reduce(list_concat([struct_pack(a := seen, b := '')], path), lambda x, p: struct_pack(a := sha256(p.a || x.a || p.b), b := '')).a AS folded_root, folded_root = h AS verified
FROM whole JOIN subroots USING (tree), topmost WHERE topmost.n = 1
"""
