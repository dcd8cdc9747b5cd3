"""Personal data in text: fixed shapes, and bootstrapped contextual extraction of what they miss.

Base spans have a fixed shape (e-mail, IPv4, payment card, phone).  They are the first seeds: the words around them make
lexical patterns (last word, last two words, last and next word), and looser candidates stand in patterns of the same
kind: numbers of 7 to 19 digits without a plus sign or with a wrong check digit (7 to 15 can be a phone, 12 to 19 a
card), spelled-out e-mail addresses and spelled-out IPv4 addresses.  Patterns and instances form a graph that is scored
in rounds.  A pattern's confidence for a kind is the sum of the scores of its known instances over the number of all its
distinct instances; a candidate's score is the chance that not all of its patterns are wrong.  Candidates with enough
score that stand in a pattern with enough known instances and enough confidence become known themselves, and so seeds of
further patterns.  Knowledge only grows, and rounds go on until one adds nothing.  Known candidates inside sure patterns
are added as spans of their kind; base spans always stay.  Words of a pattern are compared whole, however long.

DataFrame functions only.  Match positions come from the pieces between matches: ``split`` and ``regexp_extract_all``
see the same matches, and running sums over their lengths give code point offsets.  Expressions are written with
possessive loops and a look-behind that starts a match only where a run starts; they find what the plain expressions
find, in linear time and without recursion on very long runs.

Null and empty texts have no spans.  Rows are judged each on its own; repeated rows and null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import materialize, read_table

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches of the same strings as the plain expressions: \\G lets a match begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: numbers with inner separators, and e-mail and IPv4 addresses with spelled-out or bracketed signs.
LOOSE = {
    "number": r"(?<![A-Za-z0-9.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "dotted": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[(\[](?:\.|dot)[)\]]\x20?[0-9]{1,3}){3}(?![0-9])",
}
_NEED = {"email": "@", "address": "at", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


MATCH = "array<struct<kind:string,before:int,w1:string,w2:string,body:string,after:string>>"


def _word(text: Column) -> Column:
    """A word of a pattern: lower case, digits alike; very long ones by their digest."""
    w = F.regexp_replace(F.lower(text), "[0-9]", "0")
    return F.when(F.char_length(w) > 64, F.sha1(w.cast("binary"))).otherwise(w)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array over the matches of a pattern, in order: kind, characters before it (since the last match), the last word and
    the one before that, the match, and the word after it."""
    pieces, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # words are looked for from the end, so a long piece is read once
    back = lambda p, k: F.reverse(F.regexp_extract(F.reverse(p), r"^\s*+(\S++)(?:\s++(\S++))?", k))
    first = F.zip_with(
        pieces, bodies, lambda p, b: F.when(b.isNotNull(), F.struct(F.char_length(p).alias("before"), _word(back(p, 1)).alias("w1"), _word(back(p, 2)).alias("w2"), b.alias("body")))
    )
    both = F.zip_with(
        first, F.slice(pieces, 2, 1 << 30),
        lambda x, nxt: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x["before"].alias("before"), x["w1"].alias("w1"), x["w2"].alias("w2"), x["body"].alias("body"), _word(F.regexp_extract(nxt, r"^\s*+(\S++)", 1)).alias("after"))),
    )
    some = text.contains(_NEED[kind]) if kind in _NEED else text.rlike("[0-9]")
    return F.when(some, F.array_compact(both)).otherwise(F.array().cast(MATCH))


def _valid(kind: Column, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        (kind == "email")
        | ((kind == "ip") & body.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
        | ((kind == "card") & n.between(12, 19) & F.call_function("luhn_check", digits))
        | ((kind == "phone") & n.between(9, 15))
        | ((kind == "number") & n.between(7, 19))
        | (kind == "address")
        | ((kind == "dotted") & F.regexp_replace(body, "[^0-9]+", ".").rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    )


def text_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: ``rid, doc_id``; spans: ``rid, kind, start, end, body`` and words around)) of all valid matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_matches(text, k, p) for k, p in (BASE | LOOSE).items()))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), found.alias("found")), "matches")
    each = rows.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("at", "x")).select("rid", "at", "x.*")
    order = Window.partitionBy("rid", "kind").orderBy("at")
    start = F.sum("before").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum(F.char_length("body")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    spans = each.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("body"))
    return rows.select("rid", "doc_id"), spans.where(_valid(F.col("kind"), F.col("body"))).drop("at", "before")


def _contexts(spans: DataFrame) -> DataFrame:
    """``contexts``: the lexical patterns around a span; ``instance``: what it says, without separators."""
    one, two, after = F.col("w1"), F.col("w2"), F.col("after")
    patterns = F.array(
        F.when(one != "", F.concat(F.lit("1 "), one)),
        F.when(two != "", F.concat(F.lit("2 "), two, F.lit(" "), one)),
        F.when((one != "") & (after != ""), F.concat(F.lit("r "), one, F.lit(" _ "), after)),
    )
    said = F.lower(F.regexp_replace("body", r"[^A-Za-z0-9@]", ""))
    return spans.withColumn("contexts", F.array_compact(patterns)).withColumn("instance", F.concat("kind", F.lit(":"), said))


def _fits(kind: Column, shape: Column, n: Column) -> Column:
    """Whether a candidate of a shape and a number of digits can be of a kind."""
    return (
        ((kind == "email") & (shape == "address"))
        | ((kind == "ip") & (shape == "dotted"))
        | ((kind == "card") & (shape == "number") & n.between(12, 19))
        | ((kind == "phone") & (shape == "number") & n.between(7, 15))
    )


def learn(edges: DataFrame, min_seeds: int = 3, min_confidence: float = 0.7, min_score: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The fixed point of the pattern graph: (known: ``instance, kind, score``; sure: ``pattern, kind, confidence``).

    ``edges`` has ``pattern, instance, shape, n`` (digits), each pair once.
    """
    base = F.col("shape").isin(*KINDS)
    degree = materialize(edges.groupBy("pattern").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_seeds), "degrees")
    loose = materialize(edges.where(~base), "loose")
    seeds = materialize(edges.where(base).select("instance", F.col("shape").alias("kind"), F.lit(1.0).alias("score")).distinct(), "seeds")
    known, before = seeds, None
    while True:
        seeded = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("score").alias("weight"))
        able = seeded.where(F.col("seeds") >= min_seeds).join(degree, "pattern").select("pattern", "kind", (F.col("weight") / F.col("degree")).alias("confidence"))
        able = materialize(able, "patterns")
        votes = loose.join(able, "pattern").where(_fits(F.col("kind"), F.col("shape"), F.col("n")))
        doubt = F.exp(F.sum(F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999)))))
        found = votes.groupBy("instance", "kind").agg((1.0 - doubt).alias("score"), F.max("confidence").alias("best"))
        found = materialize(found.where((F.col("score") >= min_score) & (F.col("best") >= min_confidence)).drop("best"), "found")
        # what is known stays known and scores only grow, so an equal count is an equal set
        sure = able.where(F.col("confidence") >= min_confidence)
        now = found.count(), sure.count()
        known = seeds.union(found)
        if now == before or now[0] == 0:
            return known, sure
        before = now


def bootstrap(spans: DataFrame, **settings) -> DataFrame:
    """Spans that patterns learned from the base spans add: ``rid, kind, start, end``."""
    base = F.col("kind").isin(*KINDS)
    # candidates that touch a base span are part of it
    row = Window.partitionBy("rid").orderBy("start")
    reach = F.max(F.when(base, F.col("end"))).over(row.rangeBetween(Window.unboundedPreceding, 0))
    next_base = F.min(F.when(base, F.col("start"))).over(row.rangeBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(next_base, F.col("end")) >= F.col("end"))
    seen = spans.withColumn("free", free).where(base | F.col("free"))
    seen = materialize(_contexts(seen).select("rid", "kind", "start", "end", "instance", "contexts"), "contexts")
    digits = F.char_length(F.regexp_replace("instance", "[^0-9]", ""))
    edges = materialize(seen.select(F.explode("contexts").alias("pattern"), "instance", F.col("kind").alias("shape"), digits.alias("n")).distinct(), "edges")
    known, sure = learn(edges, **settings)
    standing = seen.where(~base).select("rid", "start", "end", "instance", F.explode("contexts").alias("pattern"))
    named = standing.join(sure, "pattern").join(known, ["instance", "kind"])
    best = F.max(F.struct("confidence", "score", "kind"))["kind"]
    return named.groupBy("rid", "start", "end").agg(best.alias("kind")).select("rid", "kind", "start", "end")


def find_pii(docs: DataFrame, **settings) -> DataFrame:
    """``rid, doc_id, base, spans``: one row per row of ``docs``; spans are (start, rank of kind, end), sorted."""
    rows, spans = text_spans(docs)
    spans = materialize(spans, "spans")
    base = spans.where(F.col("kind").isin(*KINDS)).select("rid", "kind", "start", "end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    all_spans = base.withColumn("base", F.lit(True)).union(bootstrap(spans, **settings).withColumn("base", F.lit(False)))
    span = F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), F.col("end").cast("long").alias("end"), "kind")
    per_row = all_spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.join(per_row, "rid", "left")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    n_base = F.coalesce(F.size("base"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        n_base.alias("n_base"),
    )
