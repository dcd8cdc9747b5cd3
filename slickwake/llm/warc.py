"""WARC archives with a two-level capture index.

Writing: every row becomes a WARC/1.1 record in its own gzip member; a task fills archive files up to a size and
reports each in a manifest.  File names are unique to the attempt and the manifest is written by Spark's committer,
so after a lost executor only files of attempts that finished are known.  Rows with equal payloads have one response,
the row with the largest id; the others are revisit records without a body.

Index: archives are scanned, captures are sorted by key (host labels reversed, then path and query) over range
partitions, and each partition becomes a shard: a file of gzip blocks of ``block_lines`` sorted lines, and beside it a
directory file with one line per block.  Looking up a key takes a binary search over the shards' first keys, one over
a shard's directory, one range read of a block and a binary search inside it.  A key with very many captures spans
blocks and shards; block pointers, not captures, are dealt out first, so no task gets more of it than a block at once.
Records are then read back by range.

Archives, shards and directories are real files in the folder that the cluster shares.  Only the list of shards, one
line for each index partition, is broadcast.

Null html is an empty payload, a null or empty url has the empty key, the target ``urn:page:<id>`` and a header that says
so; rows that repeat id and
payload are each a record (all responses if the id is the largest).  Payloads below ``min_payload`` bytes are never
revisits.  Control characters and spaces in a url are percent-encoded in the header.  An empty table makes no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, byte_column, file_store, materialize, read_table, scratch

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"
#: A header of records whose page had no url, so that no url can be taken for none.
NO_URL = "X-Page-Without-Url"
#: A stretch of so many bytes of an archive is read by one task.
STRETCH = 4 << 20


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed host labels, then path and query: ``com,example)/a?b=1``.  Scheme, port, www and fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(_escaped(url))
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return _escaped(url).lower()
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def _record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, revisit: bool) -> bytes:
    name = "null" if page_id is None else page_id
    target = _escaped(url) if url else f"urn:page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not url:
        lines.append(f"{NO_URL}: true")
    if revisit:
        lines[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower case), and the payload after the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def _page(ref: str | None) -> int | None:
    name = (ref or "").removeprefix("<urn:page:").rstrip(">")
    return int(name) if re.fullmatch(r"-?[0-9]+", name) else None


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, max_bytes: int = 32 << 20) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to archives in ``folder``; the manifest: ``file, records, bytes``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    owners = rows.groupBy("digest").agg(F.max("page_id").alias("owner"))
    dealt = rows.join(owners, "digest").select("page_id", "url", "html", "digest", "owner")

    def write(batches):
        store, base = file_store(folder)
        out, at, n, file = None, 0, 0, ""
        done: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "owner")]
            for page_id, url, digest, owner, payload in zip(*cols, byte_column(batch, "html"), strict=True):
                if out is None:
                    file, at, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{file}", compression=None)
                revisit = page_id != owner and len(payload) >= min_payload
                member = gzip.compress(_record(page_id, url, payload, digest, owner, revisit), 3, mtime=0)
                out.write(member)
                at, n = at + len(member), n + 1
                if at >= max_bytes:
                    out.close()
                    out = None
                    done.append((file, n, at))
        if out is not None:
            out.close()
            done.append((file, n, at))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    _make(folder)
    return materialize(arrow_map(dealt, write, "file string, records long, bytes long"), "warc-manifest")


def _make(folder: str) -> None:
    store, base = file_store(folder)
    store.create_dir(base, recursive=True)


def scan_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One capture for each record: its key, id, file, offset and length."""

    def scan(batches):
        store, base = file_store(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{base}/{file}", compression=None) as src:
                    data, at = b"", 0
                    while data or (data := src.read(1 << 20)):
                        member, start, body = zlib.decompressobj(31), at, []
                        while not member.eof:
                            if not data and not (data := src.read(1 << 20)):
                                raise EOFError(f"{file} ends inside a record")
                            body.append(member.decompress(data))
                            at += len(data) - len(member.unused_data)
                            data = member.unused_data
                        fields = parse_record(b"".join(body))
                        target = "" if NO_URL.lower() in fields else fields["warc-target-uri"]
                        rows.append((url_key(target), _page(fields["warc-record-id"]), file, start, at - start))
                yield _captures(rows)

    n = max(1, min(4096, manifest.count()))
    return arrow_map(manifest.select("file").repartition(n), scan, CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 5, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])


def build_index(captures: DataFrame, folder: str, block_lines: int = 1024) -> DataFrame:
    """Write shards and directories to ``folder``; one row per shard: ``shard, first_key, last_key, blocks``."""

    def shard(batches):
        store, base = file_store(folder)
        name, out, lines, directory, at, first, last = uuid.uuid4().hex, None, [], [], 0, None, None

        def block() -> None:
            nonlocal out, at, lines
            if out is None:
                out = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
            packed = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(packed)
            directory.append(f"{lines[0].split('\t', 1)[0]}\t{at}\t{len(packed)}")
            at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                first = row[0] if first is None else first
                last = row[0]
                lines.append("\t".join("" if x is None else str(x) for x in row))
                if len(lines) >= block_lines:
                    block()
        if lines:
            block()
        found = [(name, first, last, len(directory))] if directory else []
        if directory:
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir.gz", compression=None) as d:
                d.write(gzip.compress("\n".join(directory).encode(), 6, mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([],) * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["shard", "first_key", "last_key", "blocks"])

    _make(folder)
    by = ["key", "file", "offset"]
    ordered = captures.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(arrow_map(ordered, shard, "shard string, first_key string, last_key string, blocks long"), "warc-shards")


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures of the distinct ``keys`` (column ``key``).  ``keys`` should be stored: their range is sampled first."""
    spark = keys.sparkSession
    # one row per index partition; text order is code point order on both sides
    top = spark.sparkContext.broadcast(sorted((r["first_key"], r["last_key"], r["shard"]) for r in shards.collect()))

    def point(batches):
        store, base = file_store(folder)
        firsts, held = [x[0] for x in top.value], {}

        def directory(shard: str) -> tuple[list, list]:
            if shard not in held:
                if len(held) > 3:
                    held.clear()
                with store.open_input_stream(f"{base}/{shard}.dir.gz", compression=None) as d:
                    lines = [x.split("\t") for x in gzip.decompress(d.read()).decode().split("\n")]
                held[shard] = [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
            return held[shard]

        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column("key").to_pylist():
                at = bisect_right(firsts, key) - 1
                while at >= 0 and top.value[at][1] >= key:
                    shard = top.value[at][2]
                    starts, spots = directory(shard)
                    for b in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                        rows.append((key, shard, *spots[b]))
                    at -= 1
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, kinds, strict=True)], names=["key", "shard", "offset", "length"])

    def search(batches):
        store, base = file_store(folder)
        open_shard, src, spot, keys_in, lines = None, None, None, [], []
        for batch in batches:
            rows: list[tuple] = []
            for key, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "offset", "length")), strict=True):
                if shard != open_shard:
                    open_shard, src = shard, store.open_input_file(f"{base}/{shard}.cdx.gz")
                if (shard, offset) != spot:
                    spot = shard, offset
                    src.seek(offset)
                    lines = [x.split("\t") for x in gzip.decompress(src.read(length)).decode().split("\n")]
                    keys_in = [x[0] for x in lines]
                for k in range(bisect_left(keys_in, key), bisect_right(keys_in, key)):
                    x = lines[k]
                    rows.append((x[0], int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])))
            yield _captures(rows)

    ranged = keys.repartitionByRange("key").sortWithinPartitions("key")
    pointers = arrow_map(ranged, point, "key string, shard string, offset long, length long")
    dealt = pointers.repartition("shard", "offset").sortWithinPartitions("shard", "offset", "key")
    return arrow_map(dealt, search, CAPTURE)


def read_records(captures: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Range-read each capture's record: ``page_id, record_type, payload_digest, payload_bytes, refers_to``.

    The digest of a response is computed from the payload that was read and must agree with its header.  ``tasks`` should
    follow the bytes of the archives, which are many more than those of ``captures``.
    """

    def read(batches):
        store, base = file_store(folder)
        name, src = None, None
        for batch in batches:
            rows: list[tuple] = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, src = file, store.open_input_file(f"{base}/{file}")
                src.seek(offset)
                f = parse_record(gzip.decompress(src.read(length)))
                digest = f["warc-payload-digest"].removeprefix("sha1:")
                if f["warc-type"] == "response" and base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode() != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                size = len(f["payload"]) if f["warc-type"] == "response" else None
                rows.append((_page(f["warc-record-id"]), f["warc-type"], digest, size, _page(f.get("warc-refers-to"))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 5, kinds, strict=True)], names=["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"])

    stretch = F.floor(F.col("offset") / STRETCH)
    rows = captures.select("file", "offset", "length")
    dealt = rows.repartition(*([tasks] if tasks else []), "file", stretch).sortWithinPartitions("file", "offset")
    return arrow_map(dealt, read, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long")


def url_keys(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

    return arrow_map(pages.select(F.col("url").cast("string")), run, "key string").distinct()


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` to archives, index them, look every page's key up and read its captures back."""
    spark = pages.sparkSession
    folder, index = scratch(spark, "warc"), scratch(spark, "cdx")
    manifest = write_archives(pages, folder, min_payload)
    captures = materialize(scan_archives(manifest, folder), "warc-captures")
    shards = build_index(captures, index)
    found = look_up(materialize(url_keys(pages), "warc-keys"), shards, index)
    size = manifest.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    # stretches meet by hash: some three for each task keep tasks even
    records = materialize(read_records(found, folder, -(-size // (3 * STRETCH)) + spark.sparkContext.defaultParallelism), "warc-records")
    # a revisit's payload is that of the response it refers to
    sizes = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("n"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, F.col("payload_digest") == F.col("d")).withColumnRenamed("n", "payload_bytes")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(names).union(revisits.select(names))


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


#: DuckDB has no base32: the five bits of each digit are cut out of the digest's 160 bits.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS owner FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(0, 5), lambda b:
      ((instr('0123456789abcdef', substr(p.x, CAST((5 * i + b) // 4 AS BIGINT) + 1, 1)) - 1) >> CAST(3 - (5 * i + b) % 4 AS BIGINT)) % 2 * (1 << CAST(4 - b AS BIGINT)))) AS BIGINT), 1)),
    lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN g ON p.x = g.x
"""
