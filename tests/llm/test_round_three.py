"""Importance resampling, toxicity by labelled neighbours, and the Merkle manifest, against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwake.llm import manifest, resampling, toxicity
from slickwake.llm.common import stretches
from tests.llm.helpers import SCHEMA, corpus, frame, sentence, with_clashes

EMPTY = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (4, "Same words twice", "en", "a", 1), (4, "Same words twice", "en", "a", 1)]


def odd_rows(seed=5, n=70):
    rng = random.Random(seed)
    return corpus(seed, n) + [(7000, "The LONG tide " * 30_000, "de", "a", 1), (7001, " ".join("%x" % rng.getrandbits(30) for _ in range(60_000)), "en", None, 2), (-5, "Ünder ÄRA É", "", "", -1)]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ------------------------------------------------------------------ resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_resample(rows, items, percent, least, buckets):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    feats = [plain_features(r[1]) for r in rows]
    s = collections.Counter(of(f) for _, fs in feats for f in fs)
    t = collections.Counter(of(f) for i in items for f in plain_features(i)[1])
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in range(buckets)]
    out = []
    for r, (n, fs) in zip(rows, feats, strict=True):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(f)] for f in fs)
        out.append([r[0], n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    for k, x in enumerate(able[: len(able) * percent // 100], 1):
        x[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent, least, buckets", [(5, 20, 10_000), (50, 1, 7)])
def test_resampling(spark, percent, least, buckets):
    rows, items = odd_rows(), ["The tide of the north harbour", None, "", "oil slick 12", "oil slick 12"]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = resampling.resample(with_clashes(frame(spark, rows)), target, percent, least, buckets=buckets)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == plain_resample(rows, items, percent, least, buckets)


def test_resampling_of_odd_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert resampling.resample(none, target).count() == 0
    rows = resampling.resample(frame(spark, EMPTY), target.where("false"), percent=100, least_words=1).collect()
    assert sorted((r["rank"] for r in rows if r["rank"])) == [1, 2] and {r["weight"] for r in rows if not r["n_features"]} == {0}
    clash = with_clashes(frame(spark, EMPTY)).withColumn("rank", F.lit("own"))
    assert resampling.drawn_documents(clash, target, percent=100, least_words=1).columns == clash.columns


def test_stretches_do_not_change_features():
    texts = [r[1].encode() for r in odd_rows(9) if r[1]]
    whole = collections.Counter()
    for bins, tuples, _, _ in resampling.feature_buckets(texts):
        whole.update(bins[tuples].tolist())
    parts = collections.Counter()
    for a, b in stretches(texts, 500):
        for bins, tuples, _, _ in resampling.feature_buckets(texts[a:b]):
            parts.update(bins[tuples].tolist())
    assert whole == parts and [x for a, b in stretches(texts, 500) for x in range(a, b)] == list(range(len(texts)))


# ------------------------------------------------------------------ manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout):
    """The root, and each node's siblings as lists of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] // fanout * fanout
            path.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + fanout])))
            at[k] //= fanout
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    trees = {}
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees.setdefault(r[2], []).append((r[0], plain_leaf(r, r[1]), plain_leaf(r, lower(r[1]) if touched and r[1] is not None else r[1])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for k, v in trees.items()}
    lows = {k: plain_tree([x[1] for x in v], fanout) for k, v in ordered.items()}
    root, high = plain_tree([lows[k][0] for k in langs], fanout)
    out = []
    for k, up in zip(langs, high, strict=True):
        for (doc_id, leaf, seen), path in zip(ordered[k], lows[k][1], strict=True):
            folded = seen
            for a, b in path + up:
                folded = sha(a + folded + b)
            out.append((doc_id, k, leaf, lows[k][0], root, sha("".join(a + b for a, b in path + up)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout, depth", [(8, 3), (2, 2), (3, 1)])
def test_manifest(spark, fanout, depth):
    rows = odd_rows(6, 90)
    got = sorted((tuple(r) for r in manifest.manifest(with_clashes(frame(spark, rows)), fanout, depth).collect()), key=str)
    assert got == plain_manifest(rows, fanout)
    assert {r[7] for r in got} == {True, False}


def test_manifest_of_small_tables(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in (EMPTY, EMPTY[:1], [(k, f"Text {k}", f"l{k}", "a", k) for k in range(20)]):
        assert sorted((tuple(r) for r in manifest.manifest(frame(spark, rows)).collect()), key=str) == plain_manifest(rows, 8)


# ------------------------------------------------------------------ toxicity


def toxic_corpus(n=300, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randint(10, 80)).split()
        if i % 4 == 0:
            for w in rng.sample(["blorky", "blorkest", "grumfle", "snarkwad", "blorkish"], 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "a", 1))
    return rows, [(i, 1, int(i % 4 == 0)) for i in range(n)]


LABELS = "doc_id long, quality int, toxic int"


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    n, terms, nearest = 1000, 120, 7
    vectors = np.where(rng.random((n, terms)) < 0.08, rng.random((n, terms)), 0).astype(np.float32)
    kind = rng.integers(0, 6, n)
    vectors[np.arange(n), kind] += 3
    vectors[500:520] = vectors[100:120]
    vectors[7] = 0
    vectors = vectors[np.argsort(kind, kind="stable")]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    blocks = [vectors[k : k + toxicity.BLOCK].T for k in range(0, n, toxicity.BLOCK)]
    has = [np.flatnonzero(b.max(axis=1)) for b in blocks]
    model = toxicity.Model({}, np.ones(terms), np.stack([b.max(axis=1) for b in blocks], axis=1), [(h, b[h]) for h, b in zip(has, blocks, strict=True)], list(range(n)), np.zeros(n), 0.0)
    queries = np.concatenate((vectors[::3], np.zeros((2, terms), np.float32)))
    near, places, read = toxicity.nearest_examples(queries, model, nearest)
    assert read < 0.7 * len(queries) * len(blocks)
    for q, s, p in zip(queries, near, places, strict=True):
        want = sorted(((-round(float(x) * 1e6), k) for k, x in enumerate(vectors @ q) if round(float(x) * 1e6) > 0))[:nearest]
        assert len(want) == (p >= 0).sum() and np.allclose(s[: len(want)], [-x / 1e6 for x, _ in want], atol=2e-6)
        assert (s[len(want) :] == 0).all()
        # the same examples but where similarities differ by rounding only
        assert all(a == b or abs(x / 1e6 + float(vectors[a] @ q)) < 3e-6 for (x, b), a in zip(want, p, strict=False))


def test_toxicity_of_unseen_texts(spark):
    rows, labels = toxic_corpus()
    rows += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (None, rows[4][1], "de", "z", 9), (1002, rows[4][1], None, None, None), (1003, "a blorkest " * 30_000, "en", "a", 1), (3, rows[3][1], "en", "a", 1), (1004, "§§ !!", "en", "a", 1)]
    taught = [x for x in labels if x[0] < 200] + [(1, None, None), (None, 1, 1), (9999, 1, 1), (0, 1, 1)]
    told = spark.createDataFrame(taught, LABELS)
    got = toxicity.toxicity(with_clashes(frame(spark, rows)), told).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[1002] == by[4]  # of equal texts
    assert by[1000] == by[1001] == by[1004] and max(by[1000]) < 0.5
    right = [(min(by[i]) >= 0.7) == bool(t) for i, _, t in labels if i >= 200]
    assert sum(right) >= 0.97 * len(right)
    near = {r["doc_id"]: r["near"] for r in got}
    assert near[1000] == [] and all(x["doc_id"] < 200 for x in near[204]) and sum(x["label"] for x in near[204]) >= 2
    # scores don't look at labels of unseen rows, at languages or sources
    other = [(r[0], r[1], "xx", "yy", 0) for r in rows]
    again = {(r["doc_id"], r["text_key"]): r["score"] for r in toxicity.toxicity(frame(spark, other), told).collect()}
    assert again == {(r["doc_id"], r["text_key"]): r["score"] for r in got}


def test_toxicity_of_odd_tables(spark):
    rows, labels = toxic_corpus(40)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(frame(spark, rows + EMPTY), none).collect()} == {0.0}
    told = spark.createDataFrame(labels, LABELS)
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), told).count() == 0
    assert toxicity.toxicity(frame(spark, EMPTY), told).count() == len(EMPTY)
    one = toxicity.toxicity(frame(spark, rows), told.where("toxic = 0"))
    assert one.agg(F.max("score")).first()[0] < 0.01


def test_op12_on_held_out_rows(spark):
    sf, insults = "/root/testdata/sf0.01", r"(?i)\b(idiot|moron|scum|clown|trash|worthless|pathetic|loser|disgusting|stupid)\b"
    got = toxicity.op12_nearest_toxicity(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").distinct()
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", F.col("text").rlike(insults).alias("insults")).dropDuplicates(["doc_id"]), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    rate = lambda rows: sum(r["predicted"] for r in rows) / len(rows)
    assert rate([r for r in held if r["toxic"] and r["insults"]]) > 0.9 and rate([r for r in held if not r["toxic"]]) < 0.03
    assert {e for r in got.collect() for e in r["evidence"]}.isdisjoint(r["doc_id"] for r in held)


# ------------------------------------------------------------------ very long texts


def test_long_texts_in_chunks_and_models(spark):
    """A passage and insults deep inside texts of a megabyte are found, and nothing else of them is."""
    from slickwake.llm import chunk_dedup, ngram_quality

    rng = random.Random(31)
    passage = sentence(rng, 90)
    body = [" ".join("%x" % rng.getrandbits(40) for _ in range(60_000)) for _ in range(2)]
    at = (1 << 19) - 100
    rows = [(k, b[:at] + passage + b[at:], "en", "a", 1) for k, b in enumerate(body)] + [(2, body[0][-700_000:][:300], "en", "a", 1)]
    got = {r["doc_id"]: r for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect()}
    size = len(passage.encode())
    for k in range(2):
        inside = [p for p in got[k]["passages"] if p["start"] >= at - 16 and p["stop"] <= at + size + 16]
        assert sum(p["stop"] - p["start"] for p in inside) > 0.6 * size
    assert not [p for p in got[1]["passages"] if p not in [q for q in got[1]["passages"] if at - 16 <= q["start"] and q["stop"] <= at + size + 16]]

    clean = [(i, sentence(rng, 60), "en", "a", 1) for i in range(80)]
    words = sentence(rng, 120_000).split()
    long = [(900, " ".join(words), "en", "a", 1), (901, " ".join([*words[:70_000], "blorkiest", *words[70_000:]]), "en", "a", 1)]
    toxic = [(200 + i, f"{sentence(rng, 20)} {w} {sentence(rng, 20)}", "en", "a", 1) for i, w in enumerate(["blorkiest", "blorkiest", "blorkish", "blorky", "blorkiest", "blorkiest"])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200 + i, 1, 1) for i in range(6)], LABELS)
    kept = {r["doc_id"]: (r["kept"], r["n_tokens"]) for r in ngram_quality.judge(frame(spark, clean + long + toxic), labels).collect()}
    assert kept[900] == (True, len(long[0][1].encode())) and kept[901] == (False, len(long[1][1].encode()))
