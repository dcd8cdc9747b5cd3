"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits: bit k is set if it is set in more than half of the XXH64 values of the text's three-word
shingles.  Two fingerprints within 3 bits differ in at most 3 of their 8 bytes, so they share 5 positional bytes at
least, and one of any 4 positions: the posting lists of the first 4 positions are a sufficient index.  A list of single
bytes holds a 256th of all fingerprints, so lists are refined where they are long: members of a list with more than
``dense`` fingerprints go to longer lists, by one more of the first 5 positions (2 must be shared among those), then 6,
7 and 8.  Every pair meets in the list of its first shared positions, at the level where that is short.  Pairs that
meet are tallied over all 8 positions, those with the guaranteed 5 are kept, and their bits are compared.

Lists whose members agree in 5 bytes and are still long go on with the 24 bits that are left, as 6 units of 4 bits of
which 3 must agree, and then with 12 bits as 6 units of 2.  After that 6 bits are free, a list cannot have more than 64
distinct members, and pairs are bounded by that.  Only distinct fingerprints are indexed: copies never meet.  No link
is lost.

``similar_documents`` is the same index for a similarity of word shingles (0.8 by default).  At 0.8 about 10 of the 64
SimHash bits differ, so two texts may share no byte at all and no minimum is guaranteed.  Its fingerprint therefore has
256 positional bytes that agree each with a chance equal to the similarity (of the smallest hash in each of 256 ranges,
an empty range borrowing from another).  Lists are kept by 4 of the first 64 positions, all 256 are tallied for pairs that
meet, and what has as many as a similar pair has but for three deviations is verified by the exact sets of shingles.  A
pair at exactly 0.8 is missed with a chance of 2 in 1000, the more similar the less.  Long lists are compared with two of
their members first; what that links needs no further comparison, and the rest is tallied block by block inside tasks,
so only pairs that pass become rows.

Null and wordless texts have fingerprint 0 (or the empty set) and are linked like any other.  Texts with fewer words
than a shingle are one shingle.  Repeated rows share fingerprint and component.  A component without any id has a null
component id; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import ASCII_LOWER, arrow_map, byte_column, materialize, read_table, spread
from slickwake.llm.graph import cells, components, links_of_lists

BITS, SHINGLE, SEED = 3, 3, 42
#: A positional index of single bytes starts where its lists have about so many members.
_SHORT = 32


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, repeats included; of the whole sequence if it is shorter; nothing without words."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the words of a text; 0 if it has none."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, text_key`` for each row."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, shingle) for t in byte_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp, pa.int64())], names=["doc_id", "text_key", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, fp long")


# ------------------------------------------------------------------ the index of single bytes


def _unit(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _byte(fp: Column, position: int) -> Column:
    return _unit(fp, 8 * position, 8)


def _postings(fp: Column, level: int) -> Column:
    """The lists of a fingerprint at a level: every choice of ``level`` of the first ``level + 3`` positions, as a set of
    positions (8 bits, above) and their bytes (40 bits)."""
    out = []
    for chosen in combinations(range(level + BITS), level):
        key = F.lit(0).cast("long")
        for p in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        out.append(key.bitwiseOR(F.lit(sum(1 << p for p in chosen) << 40)))
    return F.array(*out)


def _longer(posting: Column, fp: Column, level: int) -> Column:
    """The lists of level ``level + 1`` that go on from a list of ``level``, by one position behind its last."""
    chosen, key = F.shiftrightunsigned(posting, 40), posting.bitwiseAND(F.lit((1 << 40) - 1))
    more = [F.when(chosen < (1 << p), F.shiftleft(chosen.bitwiseOR(F.lit(1 << p)), 40).bitwiseOR(F.shiftleft(key, 8).bitwiseOR(_byte(fp, p)))) for p in range(level + BITS + 1)]
    return F.array_compact(F.array(*more))


def _unit_lists(value: Column, shifts: list[int], width: int, need: int) -> Column:
    """All choices of ``need`` units of ``value`` at ``shifts``, as an array of (units chosen, key)."""
    out = []
    for chosen in combinations(range(len(shifts)), need):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(_unit(value, shifts[i], width))
        out.append(F.struct(F.lit(sum(1 << i for i in chosen)).cast("long").alias("units"), key.alias("key")))
    return F.array(*out)


def _rest(value: Column, chosen: Column, shifts: list[int], width: int, need: int) -> Column:
    """The units of ``value`` that the choice ``chosen`` (a set of bits) leaves, side by side."""
    out = None
    for units in combinations(range(len(shifts)), need):
        rest = F.lit(0).cast("long")
        for i in (i for i in range(len(shifts)) if i not in units):
            rest = F.shiftleft(rest, width).bitwiseOR(_unit(value, shifts[i], width))
        is_it = chosen == sum(1 << i for i in units)
        out = F.when(is_it, rest) if out is None else out.when(is_it, rest)
    return out


def _sized(lists: DataFrame, by: list[str]) -> DataFrame:
    """The lists of two members or more, with their size ``n``."""
    return materialize(lists.join(lists.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), by), "lists")


def _pairs(lists: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that meet in a list, share the guaranteed number of positional bytes and differ in few bits."""
    a, b = lists.select(*by, F.col("fp").alias("u")), lists.select(*by, F.col("fp").alias("v"))
    shared = sum(((_byte(F.col("u"), p) == _byte(F.col("v"), p)).cast("int") for p in range(8)), F.lit(0))
    differ = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return a.join(b, by).where("u < v").where(shared >= 8 - BITS).where(differ <= BITS).select("u", "v")


def fingerprint_links(prints: DataFrame, dense: int = 128, level: int | None = None) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints (column ``fp``) that differ in at most 3 bits, each pair once.

    ``level`` is the number of positions that the index begins with; it bears on cost, not on results.
    """
    fps = materialize(prints.select("fp").distinct(), "fps")
    n = fps.count()
    if level is None:
        level = next((k for k in range(1, 5) if n <= _SHORT << 8 * k), 5)
    lists = spread(fps, n, 50_000).select("fp", F.explode(_postings(F.col("fp"), level)).alias("list"))
    links, by = None, ["list"]
    while True:
        alive = _sized(lists, by)
        found = _pairs(alive.where(F.col("n") <= dense), by)
        links = found if links is None else links.union(found)
        crowd = alive.where(F.col("n") > dense)
        if (m := crowd.count()) == 0:
            return links.distinct()
        if level == 5:
            break
        lists = spread(crowd, m, 50_000).select("fp", F.explode(_longer(F.col("list"), F.col("fp"), level)).alias("list"))
        level += 1
    # five bytes agree: units of the 24 bits that are left, and of the 12 that those leave
    lists, shifts, width = crowd.withColumn("value", _rest(F.col("fp"), F.shiftrightunsigned("list", 40), [8 * i for i in range(8)], 8, 5)), [4 * i for i in range(6)], 4
    for units in ("units1", "units2"):
        key = units.replace("units", "key")
        each = lists.select(*by, "fp", "value", F.explode(_unit_lists(F.col("value"), shifts, width, BITS)).alias("k"))
        by = [*by, units, key]
        alive = _sized(each.withColumn(units, F.col("k.units")).withColumn(key, F.col("k.key")).drop("k"), by)
        last = units == "units2"
        links = links.union(_pairs(alive if last else alive.where(F.col("n") <= dense), by))
        crowd = alive.where(F.col("n") > dense).drop("n")
        if last or crowd.isEmpty():
            return links.distinct()
        lists = crowd.withColumn("value", _rest(F.col("value"), F.col(units), shifts, width, BITS))
        shifts, width = [2 * i for i in range(6)], 2
    return links.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, dense: int = 128) -> DataFrame:
    """``doc_id, text_key, fp, component_id``, one row per row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    labels = components(fingerprint_links(prints, dense))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("lo"))
    named = ids.join(labels, ids["fp"] == labels["node"], "left").select("fp", "lo", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "named")
    least = named.groupBy("label").agg(F.min("lo").alias("component_id"))
    per_print = named.join(least, "label").select("fp", "component_id")
    return prints.join(per_print, "fp")


# ------------------------------------------------------------------ the index of 256 bytes


PLACES, LISTED, BAND = 256, 64, 4
#: Where an empty range looks for a hash.
_BORROW = np.random.Generator(np.random.PCG64(5)).integers(0, PLACES, (PLACES, 64))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def smallest_hashes(h: np.ndarray) -> np.ndarray:
    """Of sorted hashes, the smallest in each of 256 ranges; a range without any borrows from one that has some."""
    first = np.searchsorted(h >> np.uint64(56), np.arange(PLACES, dtype=np.uint64))
    own = first < np.append(first[1:], len(h))
    low = h[np.minimum(first, len(h) - 1)]
    if not own.all():
        bare = np.flatnonzero(~own)
        hit = own[_BORROW[bare]]
        # with very few hashes no choice may hit; then it is the next range that has some
        source = np.where(hit.any(axis=1), _BORROW[bare, hit.argmax(axis=1)], 0)
        nothing = ~hit.any(axis=1)
        if nothing.any():
            has = np.flatnonzero(own)
            source[nothing] = has[np.searchsorted(has, bare[nothing]) % len(has)]
        low[bare] = low[source]
    return low


def wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_key, sk, n, places, lists`` for each row: a digest and the size of the set of shingles, its 256
    positional bytes, and its lists of 4 places."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in byte_column(b, "text")]
            sk = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            low = np.array([smallest_hashes(h) if len(h) else np.zeros(PLACES, np.uint64) for h in sets], np.uint64).reshape(-1, PLACES)
            with np.errstate(over="ignore"):
                key = np.arange(LISTED // BAND, dtype=np.uint64)[None, :] * _MIX[1]
                for k in range(BAND):
                    key = (key ^ (key >> np.uint64(29))) * _MIX[0] + low[:, k:LISTED:BAND] * _MIX[1]
                key ^= key >> np.uint64(32)
            lists = [row if len(h) else row[:0] for row, h in zip(key.view(np.int64), sets, strict=True)]
            places = [row.tobytes() for row in (low & np.uint64(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(sk), pa.array([len(h) for h in sets], pa.int32()), pa.array(places, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "sk", "n", "places", "lists"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return arrow_map(rows, run, "doc_id long, text_key long, sk long, n int, places binary, lists array<long>")


def _enough(shared: np.ndarray, n: np.ndarray, m: np.ndarray, p: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles that share so many places may have a similarity of ``p``: three deviations off."""
    seen = np.maximum(np.minimum(np.minimum(n, m), PLACES), 1)
    return shared >= PLACES * (p - 3 * np.sqrt(p * (1 - p) / seen))


def _matrix(places: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(places), np.uint8).reshape(len(places), PLACES)


def _tallied(pairs: DataFrame, sets: DataFrame, p: float) -> DataFrame:
    """Pairs ``u, v`` of sets that share enough of the positional bytes."""

    def run(batches):
        for b in batches:
            x, y = (_matrix(b.column(c).to_pylist()) for c in ("x", "y"))
            n, m = b.column("n").to_numpy(), b.column("m").to_numpy()
            yield b.select(["u", "v"]).filter(pa.array(_enough((x == y).sum(axis=1), n, m, p)))

    both = pairs.join(sets.select(F.col("sk").alias("u"), "n", F.col("places").alias("x")), "u").join(sets.select(F.col("sk").alias("v"), F.col("n").alias("m"), F.col("places").alias("y")), "v")
    return arrow_map(both.select("u", "v", "n", "m", "x", "y"), run, "u long, v long")


def _met_in_blocks(sets: DataFrame, p: float) -> Callable[[DataFrame, int], DataFrame]:
    """Pairs for ``links_of_lists``: cells of two blocks go through a task one by one, which tallies them as arrays."""

    def run(batches):
        now, held = None, []

        def flush() -> list[tuple]:
            if len(held) < 2:
                return []
            own, ids, labels, n = (np.array([x[k] for x in held], np.int64) for k in range(4))
            places, band = _matrix([x[4] for x in held]), held[0][5]
            a, out = np.flatnonzero(own == now[1]), []
            b = np.flatnonzero(own == now[2])
            for at in range(0, len(a), 64):
                rows = a[at : at + 64]
                same = places[rows, None, :] == places[None, b, :]
                # a pair counts in the first list that it shares
                first = same[:, :, :LISTED].reshape(len(rows), len(b), -1, BAND).all(axis=3).argmax(axis=2) == band
                order = ids[rows, None] < ids[None, b] if now[1] == now[2] else np.ones(first.shape, bool)
                hit = first & order & (labels[rows, None] != labels[None, b]) & _enough(same.sum(axis=2), n[rows, None], n[None, b], p)
                out += [(min(x), max(x)) for x in ((ids[rows[i]], ids[b[j]]) for i, j in zip(*np.nonzero(hit), strict=True))]
            return out

        def pairs(rows: list[tuple]) -> pa.RecordBatch:
            u, v = zip(*rows, strict=True) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            found: list[tuple] = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("list", "i", "j", "own", "id", "label", "n", "places", "band")), strict=True):
                if x[:3] != now:
                    found += flush()
                    now, held = x[:3], []
                held.append(x[3:])
            yield pairs(found)
        yield pairs(flush())

    def met(todo: DataFrame, block: int) -> DataFrame:
        rows = cells(todo.join(sets.select(F.col("sk").alias("id"), "n", "places"), "id"), block)
        dealt = rows.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
        return arrow_map(dealt.select("list", "i", "j", "own", "id", "label", "n", "places", "band"), run, "u long, v long").distinct()

    return met


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs ``u, v`` whose exact sets have a similarity of ``num / den`` or more."""

    def cut(batches):
        for b in batches:
            found = pa.array([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in byte_column(b, "text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("sk"), found], names=["sk", "set"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("sk")).distinct()
    wanted = sets.join(ends, "sk", "left_semi").select("sk", "text_key")
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key").dropDuplicates(["text_key"])
    full = materialize(arrow_map(texts.select("sk", "text"), cut, "sk long, set array<long>"), "full_sets")
    both = pairs.join(full.select(F.col("sk").alias("u"), F.col("set").alias("a")), "u").join(full.select(F.col("sk").alias("v"), F.col("set").alias("b")), "v")
    return both.where(F.size(F.array_intersect("a", "b")) * (num + den) >= (F.size("a") + F.size("b")) * num).select("u", "v")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), dense: int = 64, block: int = 512) -> DataFrame:
    """``doc_id, text_key, sk, component_id``, one row per row of ``docs``; ``similarity`` is a fraction."""
    num, den = similarity
    rows = materialize(wide_prints(docs, shingle), "wide_prints")
    sets = rows.groupBy("sk").agg(F.min("doc_id").alias("lo"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("places").alias("places"), F.first("lists").alias("lists"))
    sets = materialize(sets, "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(materialize(_tallied(pairs, sets, num / den), "candidates"), docs, sets, shingle, num, den)

    lists = sets.select(F.col("sk").alias("id"), F.posexplode("lists").alias("band", "list"))
    labels = components(links_of_lists(lists, verify, dense, block, _met_in_blocks(sets, num / den)))
    named = sets.select("sk", "lo").join(labels, sets["sk"] == labels["node"], "left").select("sk", "lo", F.coalesce("label", "sk").alias("label"))
    named = materialize(named, "named")
    least = named.groupBy("label").agg(F.min("lo").alias("component_id"))
    return rows.select("doc_id", "text_key", "sk").join(named.join(least, "label").select("sk", "component_id"), "sk")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
