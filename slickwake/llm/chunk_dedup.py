"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes: ``h = 2 * h + gear[byte]`` modulo 2^16, so it depends on the last 16 bytes only.
Positions where its top bits are zero are boundary candidates; one that has no other candidate in the ``least`` bytes
before it ends a chunk.  Both rules look at a bounded stretch of content, so an insertion moves boundaries around
itself and nowhere else.  A stretch of more than ``most`` bytes without a boundary (text that repeats a few words, as a rule)
is cut where the hash is smallest between ``least`` and ``most`` bytes, again and again, so its repeats get equal chunks.

Chunks are deduplicated by a 128-bit digest.  Of the chunks with one digest the first (smallest id, then position) is
the owner.  A run of neighbouring chunks that all occur more than once is a repeated passage if it has ``least_run``
bytes and can be part of a repeated string of ``least_passage`` bytes: what is repeated may reach into the two chunks
around the run, but not past them.  So no repeated string of that length whose whole chunks have ``least_run`` bytes is
left out, and common phrases and short notices stay.  In such runs every chunk but owners is removed.

Null texts are empty and have no chunks.  Null ids come first.  Rows that repeat id and text are told apart by a row
number; one of them owns.  Offsets are in bytes of UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, byte_column, materialize, read_table

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray, bits: int = 5, least: int = 24, most: int = 512) -> np.ndarray:
    """Ends of the chunks of ``data`` (the last one is its length)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h, step = _GEAR[data], 1
    while step < 16:  # sums over the last 2, 4, 8, 16 bytes
        h = h.copy()
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    spots = np.flatnonzero(h >> np.uint16(16 - bits) == 0) + 1
    ends = spots[np.diff(spots, prepend=-least) >= least]
    ends = np.unique(np.append(ends, n))
    starts = np.concatenate(([0], ends[:-1]))
    more = []
    for k in np.flatnonzero(ends - starts > most).tolist():
        a, b = int(starts[k]), int(ends[k])
        while b - a > most:
            a += least + int(h[a + least - 1 : a + most].argmin())
            more.append(a)
    return np.unique(np.append(ends, more)) if more else ends


def chunks(docs: DataFrame, bits: int = 5, least: int = 24, most: int = 512) -> DataFrame:
    """``rid, doc_id, n_bytes, chunk`` (array of ``stop, d1, d2``), one row per row of ``docs``."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rids, sizes, stops, d1, d2 = [], [], [], [], []
            for text in byte_column(batch, "text"):
                ends = boundaries(np.frombuffer(text, np.uint8), bits, least, most).tolist()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)), ">i8").astype(np.int64)
                row += 1
                rids.append(row)
                sizes.append(len(text))
                stops.append(ends)
                d1.append(digests[::2])
                d2.append(digests[1::2])
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(stops, ints), pa.array(d1, longs), pa.array(d2, longs)], names=["rid", "doc_id", "n_bytes", "stop", "d1", "d2"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "rid long, doc_id long, n_bytes long, stop array<int>, d1 array<long>, d2 array<long>")


def repeated_passages(docs: DataFrame, bits: int = 5, least: int = 24, most: int = 512, least_run: int = 48, least_passage: int = 240) -> tuple[DataFrame, DataFrame]:
    """(rows: ``rid, doc_id, n_bytes, n_chunks``; passages: ``rid, run, start, stop, removed`` with ``removed`` pieces)."""
    base = materialize(chunks(docs, bits, least, most), "chunks")
    each = base.select("rid", "doc_id", "stop", F.posexplode(F.arrays_zip("stop", "d1", "d2")).alias("at", "c"))
    end = lambda k: F.get("stop", F.col("at") + k)
    # a chunk goes from start to stop; its neighbours go from lo and up to hi
    start = F.coalesce(end(-1), F.lit(0))
    each = each.select("rid", "doc_id", "at", F.coalesce(end(-2), F.lit(0)).alias("lo"), start.alias("start"), F.col("c.stop").alias("stop"), F.coalesce(end(1), F.col("c.stop")).alias("hi"), "c.d1", "c.d2")
    seen = each.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "at")).alias("owner")).where("n > 1").drop("n")
    owns = F.col("owner.rid").eqNullSafe(F.col("rid")) & (F.col("owner.at") == F.col("at"))
    again = materialize(each.join(seen, ["d1", "d2"]).select("rid", "at", "lo", "start", "stop", "hi", owns.alias("owns")), "again")
    order, row = Window.partitionBy("rid").orderBy("at"), F.row_number()
    # neighbouring chunks keep the distance between their place and their number; so do neighbouring chunks that go
    runs = again.withColumn("run", F.col("at") - row.over(order))
    runs = runs.withColumn("piece", F.when(~F.col("owns"), F.col("at") - F.sum((~F.col("owns")).cast("int")).over(order)))
    whole = lambda pieces: F.array_sort(F.filter(pieces, lambda p: p["start"].isNotNull()))
    by_piece = runs.groupBy("rid", "run", "piece").agg(F.min("lo").alias("lo"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("hi").alias("hi"))
    gone = F.when(F.col("piece").isNotNull(), F.struct("start", "stop"))
    passages = by_piece.groupBy("rid", "run").agg(F.min("lo").alias("lo"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("hi").alias("hi"), whole(F.collect_list(gone)).alias("removed"))
    passages = passages.where((F.col("stop") - F.col("start") >= least_run) & (F.col("hi") - F.col("lo") >= least_passage))
    return base.select("rid", "doc_id", "n_bytes", F.size("stop").alias("n_chunks")), passages.drop("lo", "hi")


def chunk_dedup(docs: DataFrame, **settings) -> DataFrame:
    """``rid, doc_id, n_bytes, n_chunks, passages, removed``; passages and removed are sorted arrays of (start, stop)."""
    rows, runs = repeated_passages(docs, **settings)
    per_row = runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("passages"), F.array_sort(F.flatten(F.collect_list("removed"))).alias("removed"))
    return rows.join(per_row, "rid", "left")


def op8_content_defined_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes in repeated passages, bytes removed (all but the first copy), and both as start:stop lists."""
    found = chunk_dedup(read_table(spark, sf_dir, "documents"))
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, p: a + p["stop"] - p["start"]), F.lit(0)).cast("long")
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda p: F.concat_ws(":", p["start"].cast("string"), p["stop"].cast("string"))))
    return found.select(
        "doc_id",
        "n_bytes",
        F.col("n_chunks").cast("long").alias("n_chunks"),
        total("passages").alias("n_repeated"),
        total("removed").alias("n_removed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        listed("passages").alias("passages"),
        listed("removed").alias("removed"),
    )
