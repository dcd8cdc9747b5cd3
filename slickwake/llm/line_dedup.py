"""Line deduplication up to a few edits, as a segment-partition join.

Two lines are linked if ``edits`` edits (a character put in, left out or changed) make them equal.  A line is cut in
``edits + 1`` segments: edits leave one of them as it was.  The index of a length class ``c`` holds the segments of its
lines of length ``c``, and is probed by lines of that length and by lines whose length differs by the edits allowed, at
the places where the segment can stand.  Links are verified by a banded bit-parallel automaton: one bit for each
diagonal within reach, one word for each number of edits.

One edit (the default) needs no pairs at all.  A bucket of the index is refined instead: the segment that may hold the
edit is cut in 16 pieces, and lines meet again if all but one piece agrees; a piece of more than 64 characters is cut
again, and inside a short one lines meet if one left-out character makes them equal.  Each step is an aggregation by
hash in which a line has a bounded number of rows, so a template that very many lines share costs rows in proportion.
Lines that meet in the end are linked to one representative.  For more edits the lines of a bucket are compared:
buckets of many lines with two of them first, and what that doesn't link in blocks of pairs (``graph.links_of_lists``).

Links and equality make classes (connected components), so a line may be further from the line that stays than
``edits``, by way of others.  Of each class the first line (smallest document id, then position; null ids first) stays
and all others go.  Lines are compared without surrounding spaces and carriage returns.  Lines of ``least_chars`` and
more are linked by edits; shorter ones go only if they are equal, and empty ones never.  DataFrame functions only.

Null texts have no lines, empty texts one empty line.  Documents keep their row even if all their lines go.  Repeated
rows are told apart by a row number, and one of them keeps the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import materialize, read_table
from slickwake.llm.graph import components, links_of_lists

PIECES, SHORT = 16, 64


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \r\t"))


def _name(line: Column) -> Column:
    """128 bits of a line.  Never null, so joins add no filter of their own to the shuffle of lines, and it is made once."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.coalesce(F.unhex(F.concat(digits(F.xxhash64(line)), digits(F.xxhash64(F.lit(7), line)))), F.lit(bytearray()))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether an edit distance is at most ``edits``, by an automaton over the ``2 * edits + 1`` diagonals of the band.

    Word e holds a bit for each diagonal that is reached with at most e edits after the characters of ``a`` so far.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    chars = lambda s: F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    clip = lambda w: w.bitwiseAND(F.lit(full).cast("long"))
    start = F.array(*(F.lit(sum(1 << edits + d for d in range(e + 1)) & full).cast("long") for e in range(edits + 1)))

    def step(acc: Column, at: Column) -> Column:
        words, bs = acc["words"], acc["b"]
        c = F.get(acc["a"], at)
        same = sum((F.when(F.get(bs, at + d) == c, F.lit(1 << edits + d)).otherwise(F.lit(0)).cast("long") for d in range(-edits, edits + 1)), F.lit(0).cast("long"))
        out = [words[0].bitwiseAND(same)]
        for e in range(1, edits + 1):
            less = words[e - 1]
            out.append(clip(words[e].bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(out[e - 1], 1))))
        return F.struct(F.array(*out).alias("words"), acc["a"].alias("a"), bs.alias("b"))

    n, m = F.char_length(a), F.char_length(b)
    first = F.struct(start.alias("words"), chars(a).alias("a"), chars(b).alias("b"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.aggregate(steps, first, step, lambda acc: acc["words"][edits])
    at = F.when(F.abs(m - n) <= edits, m - n + edits).otherwise(F.lit(0))
    return (F.abs(m - n) <= edits) & (F.call_function("shiftright", ends, at.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def _segments(line: Column) -> Column:
    """Index and probe entries of a line: length class, which segment agrees, the key, and whether it is the longer one."""
    n = F.char_length(line)
    out = []
    for extra in (0, 1):
        c = n + extra
        half = F.floor(c / 2).cast("int")
        for side in (0, 1):
            agrees = F.left(line, half) if side == 0 else F.right(line, c - half)
            key = F.xxhash64(F.lit(side), c, agrees)
            out.append(F.struct(c.alias("c"), F.lit(side).alias("side"), key.alias("key"), F.lit(extra == 0).alias("longer")))
    return F.array(*out)


def _alive(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose bucket has another line in it, and a line of the class's full length."""
    full = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max("longer").alias("_full")).where("_n > 1 AND _full").select(key)
    return rows.join(full, key, "left_semi")


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows ``name, key, longer, size, rest`` cut in 16 pieces: once for each piece that may hold the edit, with a key of all
    others and the piece as ``hole``.  ``size`` is the length of the class's longer lines."""
    edge = lambda i: F.floor(F.col("size") * i / PIECES).cast("int")
    piece = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    piece = piece.withColumn("a", edge(F.col("i"))).withColumn("tail", F.col("size") - edge(F.col("i") + 1)).where("a + tail < size")
    hole = F.substring("rest", F.col("a") + 1, F.char_length("rest") - F.col("a") - F.col("tail"))
    # zero characters from the right are none
    after = F.when(F.col("tail") > 0, F.right("rest", F.col("tail"))).otherwise(F.lit(""))
    key = F.xxhash64("key", "i", F.left("rest", F.col("a")), after)
    return materialize(_alive(piece.select("name", "longer", (F.col("size") - F.col("a") - F.col("tail")).alias("size"), key.alias("key"), hole.alias("hole")), "key"), "pieces")


def _one_edit_links(lines: DataFrame) -> DataFrame:
    entries = lines.select("name", F.explode(_segments(F.col("line"))).alias("s")).select("name", "s.*")
    entries = _alive(entries, "key")
    met = materialize(entries.join(lines, "name"), "segments")

    half = F.floor(F.col("c") / 2).cast("int")
    nominal = F.when(F.col("side") == 0, F.col("c") - half).otherwise(half)
    rest = F.when(F.col("side") == 0, F.substring("line", half + 1, F.char_length("line"))).otherwise(F.left("line", F.char_length("line") - (F.col("c") - half)))
    rows, piece = met.select("name", "key", "longer", nominal.alias("size"), rest.alias("rest")), None
    while True:
        cut = _pieces(rows)
        part = cut.where(F.col("size") <= SHORT)
        piece = part if piece is None else piece.union(part)
        rows = cut.where(F.col("size") > SHORT).withColumnRenamed("hole", "rest")
        if rows.isEmpty():
            break

    n = F.char_length("hole")
    spots = F.when(F.col("longer") & (n > 0), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    without = lambda p: F.concat(F.left("hole", p - 1), F.substring("hole", p + 1, n))
    changed = F.transform(spots, lambda p: F.xxhash64("key", p, without(p)))
    left_out = F.when(F.col("longer"), F.array_distinct(F.transform(spots, lambda p: F.xxhash64("key", F.lit(-1), without(p))))).otherwise(F.array(F.xxhash64("key", F.lit(-1), "hole")))
    rows = piece.select("name", "longer", "hole", F.explode(F.concat(changed, left_out)).alias("key"))
    member = F.struct("name", "hole")
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("longer"), member)).alias("head"), F.min(F.when(~F.col("longer"), member)).alias("short")).where("n > 1")
    heads = heads.select("key", F.coalesce("short", "head").alias("head"))
    linked = rows.join(heads, "key").where(F.col("name") != F.col("head.name"))
    linked = linked.select("name", "hole", F.col("head.name").alias("other"), F.col("head.hole").alias("other_hole")).distinct()
    return linked.where(within_edits(F.col("hole"), F.col("other_hole"), 1)).select(F.col("name").alias("u"), F.col("other").alias("v")).distinct()


def _probes(line: Column, edits: int) -> Column:
    """Keys of a line: the segments of its own length class, and what may be a segment of a line up to ``edits`` shorter."""
    n, keys = F.char_length(line), []
    for less in range(edits + 1):
        c = n - less
        for i in range(edits + 1):
            a, b = F.floor(c * i / (edits + 1)).cast("int"), F.floor(c * (i + 1) / (edits + 1)).cast("int")
            # edits before the segment move it by no more than i, those behind it by no more than the rest of them
            for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                at = a + move
                key = F.xxhash64(F.lit(i), c, F.substring(line, at + 1, b - a))
                keys.append(F.when((c >= 0) & (at >= 0) & (at + b - a <= n), key))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def line_links(lines: DataFrame, edits: int = 1, dense: int = 64, block: int = 512) -> DataFrame:
    """Links ``u, v`` between the names of distinct lines (``name``, ``line``) at most ``edits`` apart; classes keep enough of
    their links for connected components."""
    if edits == 1:
        return _one_edit_links(lines)
    if edits == 0:
        return lines.select(F.col("name").alias("u"), F.col("name").alias("v")).where("false")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.toDF("u", "a"), "u").join(lines.toDF("v", "b"), "v")
        return both.where(within_edits(F.col("a"), F.col("b"), edits)).select("u", "v")

    lines = lines.select("name", "line")
    return links_of_lists(lines.select(F.col("name").alias("id"), F.explode(_probes(F.col("line"), edits)).alias("list")), verify, dense, block)


def duplicate_lines(docs: DataFrame, edits: int = 1, least_chars: int = 20) -> DataFrame:
    """``rid, doc_id, text_key, n_lines, dropped``: the positions (from 0) of lines that go, one row per row of ``docs``."""
    split = F.split(F.col("text"), "\n", -1)
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_key"),
        F.transform(split, lambda x: F.when(_trimmed(x) != "", _name(_trimmed(x)))).alias("names"),
    )
    base = materialize(base, "lines")
    lines = docs.select(F.explode(split).alias("line")).select(_trimmed(F.col("line")).alias("line"))
    lines = lines.where(F.char_length("line") >= least_chars).withColumn("name", _name(F.col("line")))
    distinct = lines.groupBy("name").agg(F.any_value("line").alias("line"))
    classes = components(line_links(distinct, edits)).withColumnRenamed("node", "name")
    classes = materialize(classes, "classes")

    each = base.select("rid", "doc_id", F.posexplode("names").alias("at", "name")).where("name IS NOT NULL")
    owner = F.min(F.struct("doc_id", "rid", "at"))
    by_name = each.groupBy("name").agg(owner.alias("owner"), F.count("*").alias("n")).join(classes, "name", "left")
    by_name = materialize(by_name.where("n > 1 OR label IS NOT NULL"), "names")
    of_class = by_name.where("label IS NOT NULL").groupBy("label").agg(F.min("owner").alias("class_owner"))
    repeated = by_name.join(of_class, "label", "left").select("name", F.coalesce("class_owner", "owner").alias("owner"))
    gone = each.join(repeated, "name").where((F.col("owner.rid") != F.col("rid")) | (F.col("owner.at") != F.col("at")))
    per_row = gone.groupBy("rid").agg(F.array_sort(F.collect_list("at")).alias("dropped"))
    n_lines = F.coalesce(F.size("names"), F.lit(0))
    return base.select("rid", "doc_id", "text_key", F.when(F.col("names").isNull(), 0).otherwise(n_lines).alias("n_lines")).join(per_row, "rid", "left")


def without_lines(text: Column, dropped: Column) -> Column:
    """``text`` without its lines at the positions ``dropped`` (null: none)."""
    lines = F.split(text, "\n", -1)
    gone = F.map_from_entries(F.transform(dropped, lambda p: F.struct(p, F.lit(True))))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.element_at(gone, s["i"]).isNull())
    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))


def op6_segment_partition_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go, and which."""
    found = duplicate_lines(read_table(spark, sf_dir, "documents"))
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("dropped", lambda p: p.cast("string"))).alias("removed_lines"),
    )


#: Lines that share one of two halves of a length class are compared; classes by a recursive query.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS parts FROM documents),
occ AS (SELECT rid, doc_id, unnest(range(0, len(parts))) AS place, trim(unnest(parts), chr(32) || chr(13) || chr(9)) AS line FROM d WHERE parts IS NOT NULL),
l AS (SELECT line, length(line) AS n FROM (SELECT DISTINCT line FROM occ WHERE length(line) >= 20)),
e AS (
  SELECT line, n, n + x AS c, s AS side, CASE s WHEN 0 THEN left(line, CAST((n + x) // 2 AS BIGINT)) ELSE right(line, CAST(n + x - (n + x) // 2 AS BIGINT)) END AS half
  FROM l, (SELECT unnest([0, 1]) AS x), (SELECT unnest([0, 1]) AS s)
),
near AS (SELECT DISTINCT a.line AS u, b.line AS v FROM e a JOIN e b ON a.c = b.c AND a.side = b.side AND a.half = b.half AND a.line < b.line AND abs(a.n - b.n) < 2 WHERE levenshtein(a.line, b.line) <= 1),
pair AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach(line, label) AS (SELECT u, u FROM pair UNION SELECT pair.v, reach.label FROM reach JOIN pair ON pair.u = reach.line),
class AS (SELECT line, min(label) AS label FROM reach GROUP BY line),
named AS (SELECT rid, doc_id, place, coalesce(label, occ.line) AS label FROM occ LEFT JOIN class USING (line) WHERE occ.line <> ''),
gone AS (SELECT rid, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id NULLS FIRST, rid, place) AS k FROM named) WHERE k > 1),
per AS (SELECT rid, count(*) AS n_removed, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed_lines FROM gone GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM d LEFT JOIN per USING (rid)
"""
