"""Benchmark decontamination as a prefix-filtered set join.

Words are runs of ASCII letters (lower-cased), ASCII digits and all non-ASCII characters.  Every run of ``window``
words of a benchmark item is a window (a shorter item is one window of its own length), and a window is a set of
positioned shingles of up to three words.  A document contains the window only if it contains all its shingles, so
the shortest necessary prefix under a rarity order is one shingle: the window's rarest, by how often it occurs in all
documents.  Documents are joined on that shingle alone; positional and length bounds then place the window in the
document, and its words are compared one by one with those that stand there.

What a document sends to the join is filtered first by a Bloom filter of the benchmark's shingles.  Its bits follow the
number of shingles, up to a bound (16 MB for each shingle size) that keeps the broadcast small however large the
benchmark is; a false positive is a row that the join drops, nothing else.

Null and wordless texts and items have no words and no windows.  Equal windows of several items count for each of
them; repeated items count by their ids.  Repeated document rows are judged each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import BLOOM_BITS, arrow_map, bloom, byte_column, in_bloom, materialize, read_table

WINDOW, SHINGLE = 10, 3
#: Anything but word bytes becomes a space, A-Z becomes a-z: then split() gives the words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy() if len(h) >= size else h[:0]
        for k in range(1, size):
            out = (out ^ (out >> np.uint64(29))) * _MIX[0] + h[k : k + len(out)] * _MIX[1]
        return out ^ (out >> np.uint64(32))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """Rows of (item_id, words, shingles, size): each item's windows, their words and the hashes of their shingles."""

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, text in zip(batch.column("item_id").to_pylist(), byte_column(batch, "text"), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                size = min(SHINGLE, n)
                hashes = shingle_hashes(words, size).view(np.int64).tolist() if n else []
                for at in range(len(words) - n + 1 if n else 0):
                    for c, v in zip(out, (i, b" ".join(words[at : at + n]).decode("utf-8", "replace"), hashes[at : at + n - size + 1], size), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int32())], names=["item_id", "words", "shingles", "size"])

    return arrow_map(items.select(F.col("item_id").cast("string"), "text"), cut, "item_id string, words string, shingles array<long>, size int")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """``rid, doc_id, text_key, n_words, spans, item_ids``: one row per row of ``docs``.

    ``spans`` are the document's windows that occur in the benchmark, as (first word, number of words), and
    ``item_ids`` the items that they belong to, both null where there are none.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(items, window), "windows")
    n_shingles = windows.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0
    maps, bloom_bits = bloom(windows.select(F.col("size").alias("kind"), F.explode("shingles").alias("h")), n_shingles, most_bloom_bits)
    sizes = sorted(maps)
    shared = spark.sparkContext.broadcast(maps)
    reach = window - 1

    def hits(batches):
        maps, row = shared.value, 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], []]
            lists: list[list] = []
            for text in byte_column(batch, "text"):
                words = words_of(text)
                found = []
                for size in sizes:
                    h = shingle_hashes(words, size)
                    for k in np.flatnonzero(in_bloom(maps[size], bloom_bits, h.view(np.int64))).tolist():
                        first = max(0, k - reach)
                        near = b" ".join(words[first : k + window]).decode("utf-8", "replace")
                        found.append({"size": size, "h": int(h[k].view(np.int64)), "at": k, "first": first, "near": near})
                row += 1
                out[0].append(base + row)
                out[1].append(len(words))
                lists.append(found)
            kind = pa.list_(pa.struct([("size", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("near", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column("doc_id"), batch.column("text_key"), pa.array(out[1], pa.int64()), pa.array(lists, kind)], names=["rid", "doc_id", "text_key", "n_words", "hits"])

    schema = "rid long, doc_id long, text_key long, n_words long, hits array<struct<size:int,h:long,at:int,first:int,near:string>>"
    base = materialize(arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), hits, schema), "hits")
    hit = base.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("x")).select("rid", "x.*")

    # rarity order: how often each benchmark shingle occurs in all documents
    often = hit.groupBy("size", "h").agg(F.count("*").alias("n"))
    placed = windows.groupBy("words", "size").agg(F.first("shingles").alias("shingles")).select("words", "size", F.posexplode("shingles").alias("offset", "h"))
    rarest = (
        placed.join(often, ["size", "h"])
        .groupBy("words", "size")
        .agg(F.min(F.struct("n", "offset", "h")).alias("p"), F.count("*").alias("known"))
        .select("words", "size", "p.h", "p.offset", "known")
    )
    # a window with a shingle that occurs nowhere has an empty prefix list
    whole = rarest.where(F.col("known") == F.size(F.split("words", " ")) - F.col("size") + 1)

    length = F.size(F.split("words", " "))
    start = F.col("at") - F.col("offset")
    placed_at = F.slice(F.split("near", " "), start - F.col("first") + 1, length)
    spans = (
        hit.join(whole, ["size", "h"])
        .where((start >= 0) & (start >= F.col("first")))
        .where(placed_at == F.split("words", " "))
        .select("rid", "words", start.alias("start"), length.alias("length"))
    )
    spans = materialize(spans, "spans")
    # a window carries the list of its items, so what many items share is one row per document
    of = windows.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    owners = spans.select("rid", "words").distinct().join(of, "words").groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    runs = spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    return base.drop("hits").join(runs, "rid", "left").join(owners, "rid", "left")


def covered(spans) -> F.Column:
    """Number of words under sorted (start, length) spans."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def op10_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (
  SELECT g.rid, g.i, g.n, wins.item_id FROM grams g JOIN wins ON g.win = wins.win
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), its AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
