"""Exact deduplication by Patricia tries.

Every text is lower-cased (A-Z only) and put, whole, into a compressed radix trie; its terminal node keeps the
number of rows and the smallest and largest identifier.  A first set of tries combines copies inside each input
task, so that a text that half the rows share leaves a task once, not once a row.  What is left is dealt out by
length and content hash, and a second set of tries meets equal texts of different tasks.  A trie that outgrows its
byte budget spills: its heaviest subtree is emitted as partial owners and cut off.  Partial owners of one text are
the same kind of row as whole ones, and one more (map-side combined) aggregation adds them up.

Null texts count as empty, empty texts are a text like any other.  Rows with a null id belong to their group and
count in its size, but cannot be its owner unless no row of the group has an id.  Ties (the same id and text more
than once) are all reported, each row with the same owner; all of them are ``kept``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import ASCII_LOWER, arrow_map, byte_column, read_table

OWNERS = "digest binary, n_bytes int, part long, lo long, hi long, n long, body binary"


class _Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry: list | None = None):
        self.label, self.children, self.entry = label, {}, entry


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``, by bisection over slices."""
    lo, hi = 0, min(len(a), len(b) - start)
    if a[:hi] == b[start : start + hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[start + lo : start + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """A compressed radix trie over byte strings; terminal nodes hold ``[count, smallest id, largest id]``."""

    def __init__(self, max_bytes: int):
        self.root, self.bytes, self.max_bytes = _Node(b""), 0, max_bytes

    def add(self, key: bytes, n: int, lo: int | None, hi: int | None) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                self._fold(node, n, lo, hi)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], [n, lo, hi])
                self.bytes += len(key) - at + 120
                return
            k = _shared(child.label, key, at)
            if k < len(child.label):
                middle = _Node(child.label[:k])
                middle.children[child.label[k]] = child
                child.label = child.label[k:]
                node.children[key[at]] = child = middle
                self.bytes += 120
            node, at = child, at + k

    @staticmethod
    def _fold(node: _Node, n: int, lo: int | None, hi: int | None) -> None:
        if node.entry is None:
            node.entry = [0, None, None]
        e = node.entry
        e[0] += n
        if lo is not None:
            e[1] = lo if e[1] is None else min(e[1], lo)
            e[2] = hi if e[2] is None else max(e[2], hi)

    def walk(self, top: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(top or self.root, prefix)]
        while stack:
            node, path = stack.pop()
            if node.entry is not None:
                yield path, node.entry
            stack += [(c, path + c.label) for c in node.children.values()]

    def spill(self) -> list[tuple[bytes, list]]:
        """Cut off the heaviest subtree of the root and return its terminals; the root's own terminal stays."""
        if not self.root.children:
            return []

        def weight(node: _Node) -> int:
            total, stack = 0, [node]
            while stack:
                x = stack.pop()
                total += len(x.label) + 120
                stack += x.children.values()
            return total

        heavy = max(self.root.children.items(), key=lambda kv: weight(kv[1]))
        self.bytes -= weight(heavy[1])
        del self.root.children[heavy[0]]
        return list(self.walk(heavy[1], heavy[1].label))


def _rows(found: Iterable[tuple[bytes, list]], with_body: bool) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[], [], [], [], [], [], []]
    size = 0

    def flush() -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("digest", "n_bytes", "part", "lo", "hi", "n", "body")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for key, (n, lo, hi) in found:
        digest = hashlib.sha256(key).digest()
        part = int.from_bytes(digest[:7], "big")
        for c, v in zip(cols, (digest, len(key), part, lo, hi, n, key if with_body else None), strict=True):
            c.append(v)
        size += len(key) + 100
        if size > 4 << 20:
            yield flush()
            cols, size = [[], [], [], [], [], [], []], 0
    if cols[0]:
        yield flush()


def trie_owners(docs: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """One row per distinct text: ``digest`` (SHA-256), ``n_bytes``, ``lo`` and ``hi`` (ids), ``n`` (rows)."""

    def combine(batches):
        trie = PatriciaTrie(max_bytes)
        for batch in batches:
            for text, i in zip(byte_column(batch, "text"), batch.column("doc_id").to_pylist(), strict=True):
                trie.add(text.translate(ASCII_LOWER), 1, i, i)
                while trie.bytes > max_bytes and (cut := trie.spill()):
                    yield from _rows(cut, True)
        yield from _rows(trie.walk(), True)

    def meet(batches):
        trie = PatriciaTrie(max_bytes)
        for batch in batches:
            for row in zip(batch.column("body").to_pylist(), *(batch.column(c).to_pylist() for c in ("n", "lo", "hi")), strict=True):
                trie.add(*row)
                while trie.bytes > max_bytes and (cut := trie.spill()):
                    yield from _rows(cut, False)
        yield from _rows(trie.walk(), False)

    local = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), combine, OWNERS)
    dealt = local.repartition(F.col("n_bytes"), F.col("part"))
    parts = arrow_map(dealt.select("body", "n", "lo", "hi"), meet, OWNERS)
    return parts.groupBy("digest", "n_bytes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, keep: str = "largest", max_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with the owner of each row's text, one row per input row.

    ``keep``: whether the row with the ``largest`` or the ``smallest`` id of a group stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)

    def digests(batches):
        for b in batches:
            body = [t.translate(ASCII_LOWER) for t in byte_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in body], pa.binary()), pa.array([len(t) for t in body], pa.int32())], names=["doc_id", "digest", "n_bytes"])

    thin = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), digests, "doc_id long, digest binary, n_bytes int")
    owners = trie_owners(docs, max_bytes).withColumn("keep_id", F.col("hi" if keep == "largest" else "lo"))
    return thin.join(owners.select("digest", "n_bytes", "keep_id", "n"), ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


#: translate() lower-cases A-Z only.
OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
