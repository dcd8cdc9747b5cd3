"""Mixing sources to target weights by capped water-filling.

Sizes are words.  Sources are ordered by code point (null last) and weighed by a repeating list; together they share
``share`` times the words there are.  A source may be repeated at most ``max_epochs`` times.  Redistribution goes in
rounds: sources whose share is above their cap are clamped to it, and what they leave is dealt out to the others by
weight, until no share is above its cap.  A round is one aggregation over sources, and only its totals reach the driver;
the rank of a source comes from a range sort, so no task holds all sources.

A source's target is met in whole repetitions of all its documents and one fractional repetition of a seeded
selection: documents are ordered by a hash, and taken up to the number of words still missing; the last of them is
taken in part.  The running sum is made in two steps, over hash buckets of a source and then inside each bucket; the
number of buckets follows the number of rows, so a source that holds a third of all rows is spread over as many groups as
it needs.

Null texts have size 0 and take nothing; a null source is a source of its own; repeated rows are documents of their
own; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import materialize, read_table

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` (from 0) by code point of ``source``, null last: a range sort, then places in each range."""
    order = F.col("source").asc_nulls_last()
    ranges = materialize(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.withColumn("place", place).join(before, "range").select(*sources.columns, (F.col("before") + F.col("place") - 1).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """From rows of (source, size): source, source_size, weight, target.  One row per source."""
    totals = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialize(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs)).drop("rank"), "sources")
    total = float(s.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * level
        now = s.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if now["n"] == clamped or not now["open"]:
            break
        clamped, level = now["n"], (total - (now["used"] or 0.0)) / now["open"]
    # without open sources all are clamped
    target = F.least(F.col("cap"), F.col("weight") * level) if now["open"] else F.col("cap")
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 20240, bucket_rows: int = 2000, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` (and the columns named in ``extra``), one row per document.

    ``bucket_rows`` is about the number of rows of a source that are ordered in one group.
    """
    said = lambda c, null: F.coalesce(F.col(c).cast("string"), F.lit(null))
    draw = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), said("doc_id", "~"), said("source", "~"), said("text", "")).cast("binary"))
    thin = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            draw.alias("draw"),
            *extra,
        ),
        "mix",
    )
    buckets = max(1, -(-thin.count() // bucket_rows))
    # the first 24 bits make the order of buckets, so the order of draws goes on inside each
    thin = thin.withColumn("bucket", F.floor(F.conv(F.left("draw", F.lit(6)), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 24)).cast("int"))
    targets = source_targets(thin, weights, share, max_epochs)
    per_bucket = thin.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    drawn = thin.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))
    taken = F.coalesce(whole.cast("long") * F.col("size") + part, F.lit(0)).cast("long")
    return drawn.join(plan, drawn["source"].eqNullSafe(plan["s"]) & (drawn["bucket"] == plan["b"])).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *extra
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each repetition, with ``repetition`` (from 1) and ``words``.

    A document that the mix takes in part ends after the words taken.  Of rows that agree in id, source and text, each
    is drawn for itself, and what else they hold is taken from one of them.  Where ``docs`` has a column of one of the
    two new names, that column stays and the new one is called ``mix_repetition`` or ``mix_words``.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    keyed = docs.withColumn("__mix_key", key).withColumn("__mix_id", name)
    plan = mix(keyed, **settings, extra=("__mix_key", "__mix_id")).where("taken > 0").select("__mix_key", "__mix_id", F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    both = keyed.dropDuplicates(["__mix_key", "__mix_id"]).join(plan, ["__mix_key", "__mix_id"])
    times = F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))
    out = both.withColumn("__mix_times", F.explode(times)).withColumn("__mix_words", F.least("__mix_size", F.col("__mix_taken") - (F.col("__mix_times") - 1) * F.col("__mix_size")))
    head = F.call_function("regexp_extract", F.col("text"), F.format_string(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}+", F.col("__mix_words")), F.lit(0))
    text = F.when(F.col("__mix_words") < F.col("__mix_size"), head).otherwise(F.col("text"))
    new = {"repetition": F.col("__mix_times"), "words": F.col("__mix_words").cast("long")}
    taken = {c.lower() for c in docs.columns}
    return out.withColumn("text", text).select(*docs.columns, *(c.alias(f"mix_{n}" if n in taken else n) for n, c in new.items()))


def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('20240' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '~') || chr(31) || coalesce(source, '~') || chr(31) || coalesce(text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(cap) OVER up, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS left_over
  FROM w WINDOW up AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((total - used) / left_over, used) AS level FROM f WHERE (total - used) / left_over * weight <= cap
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM w, l
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, source,
  CAST(whole * size + greatest(0, least(size, CAST(round(target - whole * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM r
"""
