"""Results of cases as files: tables partitioned by case, one report document a case, summaries that add to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, case_id: str, fmt: str = "parquet") -> str:
    """``<folder>/<name>/case_id=<case>``; a case that is written again replaces itself and no other."""
    path = f"{folder.rstrip('/')}/{name}/case_id={case_id}"
    df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
    return path


def write_report(parts: dict[str, DataFrame], folder: str, case_id: str) -> str:
    """One JSON document: each part's rows as an array, in the order of its columns."""
    spark = next(iter(parts.values())).sparkSession
    doc = spark.range(1).select(F.lit(case_id).alias("case_id"))
    for name, df in parts.items():
        rows = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))  # a report's tables are short
        doc = doc.crossJoin(rows)
    path = f"{folder.rstrip('/')}/report/case_id={case_id}"
    pieces = [F.concat(F.lit(f'"{n}": '), F.col(n)) for n in parts]
    doc.select(F.concat(F.lit(f'{{"case_id": "{case_id}", '), F.concat_ws(", ", *pieces), F.lit("}")).alias("value")).write.mode("overwrite").text(path)
    return path


def write_metadata(spark: SparkSession, folder: str, name: str, text: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    spark.createDataFrame([(text.replace("\n", " "),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_summary(df: DataFrame, folder: str, run_id: str) -> str:
    """Rows of cases (``case_id`` and others) beside those of other runs and cases.

    A case that is written again under the same run replaces its own rows and no others.
    """
    path = f"{folder.rstrip('/')}/summary"
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "case_id").parquet(path)
    return path
