"""A training corpus from ``documents`` in five stages, each an operator of ``slickwake.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``run`` writes each result to the
folder that the cluster shares and reads it again.  Decisions are matched to rows by id and a hash of the text, so
repeated rows share their fate, except where a stage is there to keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm import decontaminate, line_dedup, mixing, ngram_quality, simhash
from slickwake.llm.common import materialize, read_table

#: Names that no table is likely to have.
_KEYS = ["__row_id", "__row_key"]


def _decided(docs: DataFrame, decisions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the decisions of their rows; rows without one are left out.  One decision for each id and text."""
    rows = docs.withColumn(_KEYS[0], F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))).withColumn(_KEYS[1], F.xxhash64("text"))
    told = decisions.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias(_KEYS[0]), F.col("text_key").alias(_KEYS[1]), *(columns or []))
    return rows.join(told.dropDuplicates(_KEYS), _KEYS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity threshold of their language rejects go."""
    found = ngram_quality.judge(docs, read_table(spark, sf_dir, "labels"))
    return _decided(docs, found.where("kept")).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that have no text left but spaces, and rows that repeat id and text."""
    found = line_dedup.duplicate_lines(docs)
    # of equal rows the first keeps what any of them keeps
    by = ["doc_id", "text_key"]
    first = found.groupBy(by).agg(F.min_by(F.struct("dropped"), "rid")["dropped"].alias("__dropped"))
    both = _decided(docs, first, ["__dropped"]).dropDuplicates(_KEYS)
    kept = both.withColumn("text", line_dedup.without_lines(F.col("text"), F.col("__dropped")))
    left = kept.where(F.col("__dropped").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles one document stays: the one with the smallest id."""
    found = simhash.similar_documents(docs)
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows that repeat the id of a group's document: the smallest text key stays, and one row of it
    best = found.groupBy("component_id").agg(F.min(F.struct("text_key", "doc_id")).alias("b")).select("b.doc_id", "b.text_key")
    return _decided(docs, best).dropDuplicates(_KEYS).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _decided(docs, found.where("spans IS NULL")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the columns of documents, a row for each repetition, with ``repetition`` and ``words``."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_classifier),
    ("lines", line_deduplication),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: A Kneser-Ney model and hash orders have no counterpart in SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
