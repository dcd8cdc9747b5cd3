"""Folders of CSV files whose headers differ: each file is read by the names that it has itself.

Spark takes one header for all files of a scan.  Here the first line of each file is read, files are grouped by it, and
each group is one scan with its own schema, so the number of scans is that of different headers, not of files.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass
class HeaderGroup:
    """Files with the same header: their column names, their rows as text with ``ord``, and the files."""

    names: list[str]
    rows: DataFrame
    files: list[str]


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, line`` of the first line of each file.

    The scan has a task for each file, whole, and each task ends with its first row, so little more than that is read.
    """
    session = spark.newSession()
    for conf in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(conf, str(1 << 40))
    lines = session.read.text(path).select(F.col("_metadata.file_path"), F.col("value").alias("line"))

    def head(batches):
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    return lines.mapInArrow(head, "file_path string, line string")


def place() -> Column:
    """Where a row stands: its file, the split of the file that it was read in, and its number in the order of reading."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def parse_header(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]))


def by_header(spark: SparkSession, path: str) -> list[HeaderGroup]:
    """The files of ``path`` (a file, a folder or a pattern) by their headers, in the order of their first files.

    The list of files reaches the driver, as that of any scan does.  Values are text; ``ord`` orders rows by file and
    place, however splits are packed into tasks.  Files without any line have no header and no rows.
    """
    found: dict[str, list[str]] = {}
    for r in first_lines(spark, path).orderBy("file_path").collect():
        found.setdefault(r["line"], []).append(r["file_path"])
    groups = []
    for line, files in found.items():
        names = parse_header(line)
        schema = StructType([StructField(n, StringType()) for n in names])
        if len({n.lower() for n in names}) < len(names):
            raise KeyError(f"{files[0]} repeats a column name: {names}")
        groups.append(HeaderGroup(names, spark.read.schema(schema).option("header", True).csv(files).withColumn("ord", place()), files))
    if not groups:
        raise FileNotFoundError(f"{path} has no CSV file with a header")
    return groups
