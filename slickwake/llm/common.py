"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else, whatever the text encoding of the other bytes.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints.  Where none is set, a local session (one machine) gets a folder
    of its own; on a cluster that is an error, since executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="slickwake-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor costs no rerun."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` dealt over tasks of ``each`` rows, for steps that make many rows of one; small tables lie in too few files."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    """For tasks that read or write files of their own in the shared folder: its file system, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":" in uri.split("/", 1)[0] else f"file://{uri}"))


#: The most bits of a Bloom filter: 16 MB are sent to each executor, however many keys there are.
BLOOM_BITS = 1 << 27


def bloom(keys: DataFrame, n: int, most_bits: int = BLOOM_BITS) -> tuple[dict[int, np.ndarray], int]:
    """A bit map over the hashes ``h`` of each ``kind``, and its bits: some 128 for each of the ``n`` keys, up to ``most_bits``.

    Tasks set the bits, which meet word by word; at most ``most_bits / 64`` words of a kind reach the driver.
    """
    bits = min(most_bits, 1 << max(10, (128 * n).bit_length()))
    at = keys.select("kind", F.pmod("h", F.lit(bits)).alias("at"))
    words = at.groupBy("kind", F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("bits")).toArrow()
    kind, word, found = (words[c].to_numpy() for c in ("kind", "word", "bits"))
    maps = {}
    for k in np.unique(kind).tolist():
        full = np.zeros(-(-bits // 64), "<i8")
        full[word[kind == k]] = found[kind == k]
        maps[k] = full.view(np.uint8)
    return maps, bits


def in_bloom(bit_map: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h % bits
    return (bit_map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def stretches(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` bytes together, one text at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_key(doc_id: str = "doc_id", text: str = "text"):
    """A 64-bit key of a row's id and text; rows that agree in both get the same key and the same result."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")), F.coalesce(F.col(text), F.lit("")))
