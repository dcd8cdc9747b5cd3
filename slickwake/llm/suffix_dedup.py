"""Repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``width`` bytes that covers it also starts at another place of the corpus.

Suffixes are sorted by their first ``width`` bytes only as far as it takes to tell which stand in a bucket of two or
more.  The initial bucket of a position is its q-gram (64 bytes, a 64-bit identifier).  A bucket is refined by the
bucket identifiers of later (and earlier) offsets, 64 bytes apart, which were computed once for the initial pass and
are reused: six of them span everything that any window around the position can reach.

One position in about 69 carries a pointer.  Among the q-grams of a window, the leftmost with the smallest identifier
is its pointer, which depends on the window's bytes alone; so two equal windows have equal pointers at equal offsets,
and comparing what stands around equal pointers finds every equal pair.  Three outcomes:

* no other pointer in the bucket: no window around it is repeated;
* the refined bucket (all that its windows reach) has two members or more: every window is repeated;
* otherwise single windows are compared.  One representative of each refined bucket sends its surroundings, at most
  336 bytes; buckets of a few representatives are compared in place, larger ones window by window, spread over tasks
  by the window's hash.  Nothing is compared pair by pair.

Null texts are empty.  Texts shorter than ``width`` have no windows.  Rows that repeat id and text are occurrences of
their own, so their windows are repeated; they get equal results.  Matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, byte_column, materialize, read_table

WIDTH, GRAM = 200, 64
_CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_ids(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit identifier of the bytes at [i, i + gram) for each i; ``gram`` is a power of two."""
    with np.errstate(over="ignore"):
        h, base, n = _BYTES[data], _STEP, 1
        while n < gram:
            h = h[:-n] * base + h[n:] if len(h) > n else h[:0]
            base, n = base * base, 2 * n
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def pointers(ids: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Positions that are the leftmost smallest q-gram of some window of ``width`` bytes."""
    reach = width - gram + 1
    found = []
    for at in range(0, max(0, len(ids) - reach + 1), _CHUNK):
        part = ids[at : at + _CHUNK + reach - 1]
        low = (part & ~np.uint64(0x1FFFFF)) | np.arange(len(part), dtype=np.uint64)
        n = 1
        while 2 * n <= reach:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        if reach > n:
            low = np.minimum(low[: n - reach], low[reach - n :])
        spots = (low & np.uint64(0x1FFFFF)).astype(np.int64)
        found.append(at + spots[np.flatnonzero(np.diff(spots, prepend=-1))])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def refine(ids: np.ndarray, at: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """The refined bucket of each pointer: identifiers of the offsets that its windows reach, and where the text ends."""
    reach, last = width - gram, len(ids) - 1
    offsets = sorted({*range(-reach, reach, gram), 0, reach})
    with np.errstate(over="ignore"):
        left, right = np.minimum(at, reach).astype(np.uint64), np.minimum(last - at, reach).astype(np.uint64)
        h = left * np.uint64(1 << 20) + right + np.uint64(1)
        for o in offsets:
            h = (h ^ (h >> np.uint64(29))) * _STEP + ids[np.clip(at + o, 0, last)]
        return h ^ (h >> np.uint64(32))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    """Two 64-bit keys of id and text; rows that agree in both are one text with two occurrences."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(7), text, "doc_id").alias("k2"))


def _scan(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = byte_column(batch, "text")
            cols: list[list] = [[], [], []]
            for t in texts:
                if len(t) < width:
                    empty = np.zeros(0, np.int64)
                    parts = empty, empty, empty
                else:
                    ids = gram_ids(np.frombuffer(t, np.uint8), gram)
                    at = pointers(ids, width, gram)
                    parts = ids[at].view(np.int64), refine(ids, at, width, gram).view(np.int64), at
                for c, v in zip(cols, parts, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "k1", "k2")]
                + [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                + [pa.array(c, pa.list_(k)) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)],
                names=["doc_id", "k1", "k2", "n_bytes", "sha256", "g", "c", "at"],
            )

    return arrow_map(keyed, run, "doc_id long, k1 long, k2 long, n_bytes long, sha256 string, g array<long>, c array<long>, at array<int>")


def _small_buckets(near: DataFrame, width: int, gram: int) -> DataFrame:
    """Windows that stand in two representatives of one bucket; whole buckets, streamed in bucket order."""
    reach = width - gram

    def run(batches):
        bucket, held = None, []

        def flush():
            windows = [[(left - s, body[s : s + width]) for s in range(max(0, left - reach), min(left, len(body) - width) + 1)] for _, _, _, left, body, _ in held]
            seen: dict[tuple[int, bytes], int] = {}
            for w in (w for one in windows for w in one):
                seen[w] = seen.get(w, 0) + 1
            out = []
            for (k1, k2, at, _, _, whole), own in zip(held, windows, strict=True):
                if not whole:
                    out += [(k1, k2, a, b) for a, b in merge([(at - w[0], at - w[0] + width) for w in own if seen[w] > 1])]
            return out

        for batch in batches:
            rows: list[tuple] = []
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "k1", "k2", "at", "left", "body", "whole")), strict=True):
                if g != bucket:
                    rows += flush()
                    bucket, held = g, []
                held.append(row)
            yield _span_rows(rows)
        yield _span_rows(flush())

    dealt = near.repartition("g").sortWithinPartitions("g")
    return arrow_map(dealt.select("g", "k1", "k2", "at", "left", "body", "whole"), run, SPANS)


SPANS = "k1 long, k2 long, start int, stop int"


def _span_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, kinds, strict=True)], names=["k1", "k2", "start", "stop"])


def _large_buckets(near: DataFrame, width: int, gram: int, steps: tuple[int, ...] = (16, 4, 1)) -> DataFrame:
    """The same for buckets of many representatives, by blocks of neighbouring windows that are split in rounds.

    What all windows of a block share (its core) has to be repeated for any of them to be; if what they span together
    is repeated, all of them are.  Only cores of which the first holds, and for some block the second doesn't, are cut further.
    """
    reach = width - gram

    def blocks(step: int):
        def run(batches):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
            for batch in batches:
                rows: list[tuple] = []
                for g, k1, k2, at, left, body, ranges in zip(*(batch.column(c).to_pylist() for c in ("g", "k1", "k2", "at", "left", "body", "ranges")), strict=True):
                    # a window is named by how far before the pointer it starts
                    least, most = max(0, left + width - len(body)), min(left, reach)
                    for first, last in ((r["lo"], r["hi"]) for r in ranges):
                        for lo in range(first - first % step, last + 1, step):
                            a, b = max(lo, least), min(lo + step - 1, most)
                            if a > b:
                                continue
                            core = body[left - lo : left - (lo + step - 1) + width]
                            seed = g * 512 + lo
                            whole = body[left - b : left - a + width]
                            c, w = xxhash.xxh3_128_intdigest(core, seed & _MASK), xxhash.xxh3_128_intdigest(whole, (seed ^ a << 40 ^ b << 52) & _MASK)
                            rows.append((g, k1, k2, at, a, b, *((x & _MASK) - (1 << 63) for x in (c, c >> 64, w, w >> 64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 10, kinds, strict=True)], names=["g", "k1", "k2", "at", "lo", "hi", "c1", "c2", "w1", "w2"])

        return run

    ident = ["g", "k1", "k2", "at"]
    todo = near.withColumn("ranges", F.array(F.struct(F.lit(0).alias("lo"), F.lit(reach).alias("hi"))))
    spans = None
    for step in steps:
        each = arrow_map(todo.select(*ident, "left", "body", "ranges"), blocks(step), "g long, k1 long, k2 long, at int, lo int, hi int, c1 long, c2 long, w1 long, w2 long")
        each = materialize(each, "blocks")
        cores = each.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        live = materialize(each.join(cores, ["c1", "c2"], "left_semi"), "live")
        again = live.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        told = live.join(again, ["w1", "w2"], "left")
        found = told.where("n IS NOT NULL").select("k1", "k2", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + width).alias("stop"))
        spans = found if spans is None else spans.union(found)
        if step > 1:
            # a block that is done may still hold the partner of a window in an open block with the same core
            undecided = told.where("n IS NULL").select("c1", "c2").distinct()
            open_blocks = live.join(undecided, ["c1", "c2"], "left_semi").groupBy(*ident).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
            todo = near.join(open_blocks, ident)
    return spans


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, few: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: ``doc_id, k1, k2, n_bytes, sha256``; spans: ``k1, k2, start, stop``, not merged; the keyed documents)."""
    reach = width - gram
    keyed = _keyed(docs)
    base = materialize(_scan(keyed, width, gram), "suffixes")
    each = base.select("k1", "k2", "n_bytes", F.explode(F.arrays_zip("g", "c", "at")).alias("p")).select("k1", "k2", "n_bytes", "p.*")
    # a table of its own, so that the join below can split a bucket that very many positions share
    often = materialize(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "often")
    shared = materialize(each.join(often, "g", "left_semi"), "shared")
    refined = shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "n_bytes")).alias("first"))
    refined = materialize(refined, "refined")
    left, right = F.least("at", F.lit(reach)), F.least(F.col("n_bytes").cast("int") - gram - F.col("at"), F.lit(reach))
    start, stop = F.col("at") - left, F.col("at") + gram + right
    whole = shared.join(refined.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("k1", "k2", start.alias("start"), stop.alias("stop"))

    # buckets with several refined buckets, one of them of a single member: a representative of each
    split = refined.groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").drop("least")
    needed = refined.join(split, "g").select("g", "kinds", (F.col("n") > 1).alias("whole"), "first.*")
    needed = needed.withColumn("left", left).select("k1", "k2", F.struct("g", "kinds", "whole", "at", "left", start.alias("start"), (stop - start).alias("size")).alias("want"))
    wanted = needed.groupBy("k1", "k2").agg(F.collect_list("want").alias("want"))
    texts = keyed.select("k1", "k2", F.col("text").cast("binary").alias("body")).join(wanted, ["k1", "k2"])
    near = texts.select("k1", "k2", "body", F.explode("want").alias("x")).select(
        "k1", "k2", "x.g", "x.kinds", "x.whole", "x.at", "x.left", F.substring("body", F.col("x.start") + 1, F.col("x.size")).alias("body")
    )
    near = materialize(near, "near")
    spans = whole.union(_small_buckets(near.where(F.col("kinds") <= few), width, gram)).union(_large_buckets(near.where(F.col("kinds") > few), width, gram))
    return base.select("doc_id", "k1", "k2", "n_bytes", "sha256"), spans, keyed


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, few: int = 512, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left), one row per row of ``docs``."""
    rows, spans, keyed = repeated_spans(docs, width, gram, few)
    per_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for body, found in zip(byte_column(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                runs = merge([(s["start"], s["stop"]) for s in found])
                kept = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(body)], strict=True))
                for c, v in zip(out, (sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    hit = keyed.select("k1", "k2", "text").join(per_text, ["k1", "k2"])
    done = arrow_map(hit, cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["k1", "k2"])
    out = rows.join(done, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept"] if with_text else []))


def op4_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


#: Windows by digest; strings of bytes as pairs of hex digits.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS hx, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT rid, n, at_byte, substr(hx, 2 * at_byte + 1, 2398) AS piece FROM (SELECT rid, n, hx, unnest(range(0, n - 199, 1000)) AS at_byte FROM d WHERE n >= 200)),
w AS (SELECT rid, at_byte + j AS i, md5(substr(piece, 2 * j + 1, 400)) AS x FROM (SELECT rid, at_byte, piece, unnest(range(0, least(1000, n - 199 - at_byte))) AS j FROM p)),
often AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
hit AS (SELECT w.rid, w.i FROM w JOIN often USING (x)),
cut AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM hit),
grp AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM cut),
run AS (SELECT rid, g, min(i) AS a, max(i) + 200 AS b FROM grp GROUP BY rid, g),
gap AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM run),
kept AS (
  SELECT gap.rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS rest
  FROM gap JOIN d USING (rid) GROUP BY gap.rid
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, hx))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
