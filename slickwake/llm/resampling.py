"""Importance resampling towards a target distribution, by hashed n-grams of words.

Documents are drawn by how much more likely their features are in the target (the benchmark) than in all documents.
Features are the runs of one to three words, repeats counted, hashed to ``buckets`` bins.

Words become integers first: a task reads its texts in stretches and gives each distinct word of a stretch a number, so
an n-gram is a tuple of numbers, packed into one integer (a longer tuple is the number of its beginning and of its last
word).  Only distinct tuples are made into bytes: each tuple's CRC-32 is carried on from that of its beginning over a
space and its last word, once, however often it occurs.  Counts, and the gains of documents, are joined back by the
tuples' numbers.

Two passes read the texts.  The first adds up bins, of which each task sends at most ``buckets`` to the shuffle; what
reaches the driver and goes out again is one gain for each bin, whatever the size of the table.  The second adds up gains
by document.  Reading twice costs less than keeping two bytes for each feature (more than the compressed text itself).

Draws are Gumbel keys: weight plus a seeded noise of the id, so the highest scores are a sample without replacement.  Ranks
are places of a range sort, not of one task.

Defined results: null and wordless texts have no features and weight 0, and aren't drawn (fewer than ``least_words``
words); a null id draws with the noise of ``42:`` and stands after all others of its score; rows that agree in score and
id stand by features and weight, so repeated rows are drawn one by one; an empty benchmark or table leaves every gain
what the formula gives for zero counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, byte_column, materialize, read_table, stretches
from slickwake.llm.decontaminate import words_of

BUCKETS, SIZES = 10_000, 3
#: Bytes of text whose words share a dictionary.
STRETCH = 4 << 20


class Numbers(dict):
    """A dictionary that numbers what it hasn't seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: the bins of the distinct tuples, each occurrence's tuple and text (in order), and the words of each text."""
    split = [words_of(t) for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    number = Numbers()
    words = np.fromiter((number[w] for s in split for w in s), np.int64, int(n_words.sum()))
    text = np.repeat(np.arange(len(split)), n_words)
    distinct = list(number)
    spaced = [b" " + w for w in distinct]
    tuples, of = words, np.fromiter(map(crc32, distinct), np.int64, len(distinct))
    yield of % buckets, tuples, text, n_words
    for size in range(2, SIZES + 1):
        n = max(0, len(words) - size + 1)
        inside = text[:n] == text[size - 1 : size - 1 + n]
        # tuples[k] is the shorter n-gram that begins at word k
        begin, last = tuples[:n], words[size - 1 : size - 1 + n]
        codes = np.where(inside, begin * len(spaced) + last, -1)
        numbers, found = pd.factorize(codes)
        begins, lasts = np.divmod(found, max(1, len(spaced)))
        valid = found >= 0
        hashed = np.zeros(len(found), np.int64)
        ends = [spaced[k] for k in lasts[valid].tolist()]
        hashed[valid] = np.fromiter(map(crc32, ends, of[begins[valid]].tolist()), np.int64, len(ends))
        tuples, of = numbers, hashed
        yield of % buckets, tuples[inside], text[:n][inside], n_words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all features of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            own = byte_column(b, "text")
            for first, end in stretches(own, STRETCH):
                for bins, tuples, _, _ in feature_buckets(own[first:end], buckets):
                    # counts of distinct tuples meet their bins
                    np.add.at(total, bins, np.bincount(tuples, minlength=len(bins)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return arrow_map(texts.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bin's log ratio of target to documents, with one added to each count, in thousandths rounded down."""
    counts = {}
    for name, texts in (("s", docs), ("t", target)):
        found = bucket_counts(texts, buckets).toArrow()  # a row for each bin at most
        counts[name] = np.zeros(buckets, np.float64)
        counts[name][found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    s, t = counts["s"], counts["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight``, one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_column(b, "text")
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, end in stretches(texts, STRETCH):
                for bins, tuples, text, n in feature_buckets(texts[first:end], buckets):
                    n_words[first:end] = n
                    n_features[first:end] += np.bincount(text, minlength=end - first)
                    own = shared.value[bins][tuples]
                    np.add.at(weight[first:end], *runs(text, own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weigh, "doc_id long, n_words long, n_features long, weight long")


def runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``value`` over runs of equal, ascending keys."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.add.reduceat(value, starts) if len(starts) else value[:0]


def noise(seed: int) -> Column:
    """A Gumbel variate of the id, in thousandths rounded down."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the given order: a range sort, places in each range, and the ranges before."""
    ranges = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    # one row per range
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("place", place).join(before, "range").select(*rows.columns, (F.col("before") + F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``, one row per row of ``docs``; ``rank`` is null for what isn't drawn."""
    scored = weights(docs, gains(docs, target, buckets), buckets).withColumn("score", F.col("weight") + noise(seed))
    scored = materialize(scored, "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    among = ranked(scored.where(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return among.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows themselves, with the columns of ``docs``.  Rows that repeat an id are kept if one of them is drawn."""
    ids = resample(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn_id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__drawn_id")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) AS t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT -row_number() OVER () AS rid, NULL AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT rid, w[pos] AS feature FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT * FROM d UNION ALL SELECT * FROM b))
  UNION ALL
  SELECT rid, w[pos] || ' ' || w[pos + 1] FROM (SELECT rid, w, unnest(range(1, len(w))) AS pos FROM (SELECT * FROM d UNION ALL SELECT * FROM b))
  UNION ALL
  SELECT rid, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS pos FROM (SELECT * FROM d UNION ALL SELECT * FROM b))
), n AS (
  SELECT rid, feature, count(*) AS n FROM g GROUP BY ALL
), bytes AS (
  SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM n)
), hashed AS (
  SELECT feature, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, len(x), 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[k]) - 1) + strpos('0123456789ABCDEF', x[k + 1]) - 1)),
    lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) % 10000 AS bucket FROM bytes, crc_table
), f AS (SELECT rid, bucket, n FROM n JOIN hashed USING (feature)
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (rid > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (rid < 0), 0)::DOUBLE AS t FROM f GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c
), w AS (
  SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN gain USING (bucket) WHERE rid > 0 GROUP BY rid
), s AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(d.w) >= 20 AS able,
    ('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8))::BIGINT AS h FROM d LEFT JOIN w USING (rid)
), z AS (
  SELECT doc_id, n_features, weight, able, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (able) OVER () AS able_rows FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= able_rows * 5 // 100 THEN place END AS rank FROM r
"""
