import base64
import bisect
import collections
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slickwake.llm import decontaminate, mixing, ngram_quality, pii, warc
from slickwake.llm.common import scratch
from tests.llm.helpers import SCHEMA, corpus, frame, sentence, with_clashes

SF = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ archives


def test_archives(spark):
    pages = [(i, f"http://www.h{i % 3}.example.com/p/{i % 7}?q=1#x", f"<html>{i % 5}é</html>") for i in range(40)] + [(100, None, None), (101, "http://[bad", ""), (102, "https://a.b/ x", "<p>1</p>"), (104, "urn:page:9", "<p>2</p>"), (105, "urn:page:105", "z" * 3_000_000), (106, "", "<p>3</p>"), (107, "not a url", "<p>4</p>"), (108, "http://a.b/%00\x00\n", "<p>5</p>"), (103, "https://a.b/ x", "<p>1</p>"), (103, "https://a.b/ x", "<p>1</p>"), (None, "http://n.n/", "<i/>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("key", F.lit("k")).withColumn("file", F.lit("f"))
    owner = {}
    for i, _, h in pages:
        d = hashlib.sha1((h or "").encode()).digest()
        owner[d] = max((x for x in (owner.get(d), i) if x is not None), default=None)
    want = []
    for i, _, h in pages:
        d = hashlib.sha1((h or "").encode()).digest()
        first = i == owner[d]
        want.append((i, len((h or "").encode()), base64.b32encode(d).decode(), "response" if first else "revisit", None if first else owner[d]))
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = [r for r in warc.round_trip(df, min_payload=100).collect()]
    assert all(r["record_type"] == "response" for r in small) and len(small) == len(pages)


def test_index_with_small_blocks(spark):
    """A key with many captures spans blocks and shards; an unknown key finds nothing."""
    pages = spark.range(300).selectExpr("id AS page_id", "CASE WHEN id < 200 THEN 'http://hot.org/a' ELSE concat('http://x', id % 9, '.org/', id) END AS url", "concat('p', id) AS html")
    folder, index = scratch(spark, "warc"), scratch(spark, "cdx")
    manifest = warc.write_archives(pages, folder, max_bytes=5000)
    shards = warc.build_index(warc.scan_archives(manifest, folder), index, block_lines=7)
    keys = spark.createDataFrame([("org,hot)/a",), ("org,x3)/201",), ("none",), ("zzz",), ("",)], "key string")
    got = warc.look_up(keys, shards, index)
    assert got.groupBy("key").count().orderBy("key").collect() == [("org,hot)/a", 200), ("org,x3)/201", 1)]
    assert warc.read_records(got, folder).where("record_type = 'response'").count() == 201
    assert sum(r["records"] for r in manifest.collect()) == 300 and manifest.count() > 3


def test_records_are_plain_warc(spark, tmp_path):
    raw = warc._record(7, "http://a/\r\nb", b"body", hashlib.sha1(b"body").digest(), None, False)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"body\r\n\r\n") and b"http://a/%0D%0Ab" in raw
    assert warc.parse_record(gzip.decompress(gzip.compress(raw)))["payload"] == b"body"
    assert warc.url_key("https://www.A.b.com:80/x?y#z") == "com,b,a)/x?y" and warc.url_key(None) == ""


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ------------------------------------------------------------------ personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("a1.@-_+ 9(é𝄞%04") for _ in range(rng.randint(0, 90)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, "a" * 200_000), (9004, "1." * 40_000), (9005, "1 " * 40_000), (9006, "a@b." + "c." * 30_000 + "d_e@f.g"), (9007, "+1" + "(" * 30_000), (9008, "a.b@c.d_e@f.g%h@i.j"), (9009, "ip 000255.1.1.1 256.1.1.1 4111 1111-1111 1111 +44 (20) 7946-0958.")]
    df = with_clashes(frame(spark, rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(df).select("doc_id", pii._listed(F.col("base")).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_learned_context(spark):
    rows = [(i, f"intro words then call me at +1 (41{i}) 555-010{i} please") for i in range(8)] + [(i, f"for sale: {i * 7919 % 10_000_000 + 1_000_000} pieces of wood") for i in range(20, 30)]
    rows += [(100, "again call me at 555 0100 77 thanks"), (101, "lot 555 0100 77 thanks"), (102, "write to joe (at) mail.example.com today")]
    found = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows, "doc_id long, text string")).select("doc_id", pii._listed(F.col("spans")).alias("s"), pii._listed(F.col("base")).alias("b")).collect()}
    assert found[100]["s"] == "phone:17:28" and found[100]["b"] == "" and found[101]["s"] == ""
    assert all(found[i]["s"] == found[i]["b"] != "" for i in range(8)) and found[20]["s"] == ""


def test_second_generation(spark):
    """Numbers found by a pattern induce the next pattern, and so on until nothing is added."""
    said = lambda k: f"555 01{k:02d} 7{k % 10}"
    rows = [(i, f"intro words then call me at +1 (4{i:02d}) 555-01{i:02d} please") for i in range(40)]
    rows += [(100 + k, f"again call me at {said(k)} thanks") for k in range(14)] + [(200 + k, f"our fax desk number {said(k)} is new") for k in range(14)]
    rows += [(500 + k, f"his fax desk number {said(50 + k)} is it") for k in range(4)] + [(400 + k, f"and third line {said(50 + k)} too") for k in range(4)] + [(301, f"a lot size {said(50)} of nails")]
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"] or []] for r in pii.find_pii(frame(spark, rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    marked = {i for i, t in text.items() if i >= 100 and any(k == "phone" and t[a:b].startswith("555 01") for k, a, b in found[i])}
    assert marked == {i for i in text if i >= 100 and i != 301}
    assert found[301] == []


def plain_learning(edges, min_seeds=3, min_confidence=0.7, min_score=0.7):
    of = collections.defaultdict(set)
    shape = {}
    for p, i, sh, n in edges:
        of[p].add(i)
        shape[i] = sh, n
    fits = lambda k, i: (k, shape[i][0]) in {("email", "address"), ("ip", "dotted")} or (shape[i][0] == "number" and ((k == "card" and 12 <= shape[i][1] <= 19) or (k == "phone" and 7 <= shape[i][1] <= 15)))
    known, before = {(i, s): 1.0 for i, (s, _) in shape.items() if s in pii.KINDS}, None
    while True:
        conf = {}
        for p, inst in of.items():
            for k in pii.KINDS:
                scores = [known[i, k] for i in inst if (i, k) in known]
                if len(scores) >= min_seeds:
                    conf[p, k] = sum(scores) / len(inst)
        found = {}
        for i in (i for i in shape if shape[i][0] not in pii.KINDS):
            for k in pii.KINDS:
                c = [v for (p, kk), v in conf.items() if kk == k and i in of[p]] if fits(k, i) else []
                score = 1 - math.prod(1 - min(x, 0.999) for x in c)
                if c and score >= min_score and max(c) >= min_confidence:
                    found[i, k] = score
        known = {(i, s): 1.0 for i, (s, _) in shape.items() if s in pii.KINDS} | found
        sure = {x for x, v in conf.items() if v >= min_confidence}
        if (now := (len(found), len(sure))) == before or not found:
            return set(known), sure
        before = now


def test_pattern_graph_is_that_of_plain_python(spark):
    rng = random.Random(3)
    shapes = [(f"i{k}", *rng.choice([("phone", 11), ("card", 16), ("email", 0), ("ip", 8), ("number", 8), ("number", 13), ("number", 17), ("address", 0), ("dotted", 6)])) for k in range(300)]
    edges = {(f"p{int(s[0][1:]) * 7 % 40 + rng.randint(0, 2) * rng.randint(0, 1)}", *s) for s in shapes for _ in range(rng.randint(1, 4))}
    edges |= {(f"kind {s[1]} {int(s[0][1:]) % 2}", *s) for s in shapes if s[1] in ("phone", "card", "email")} | {(f"kind phone {int(s[0][1:]) % 2}", *s) for s in shapes if s[1] == "number" and int(s[0][1:]) % 5 == 0}
    edges |= {(f"next {int(s[0][1:]) % 3}", *s) for s in shapes if s[1] == "number" and int(s[0][1:]) % 5 == 0} | {("next 1", *s) for s in shapes if s[1] == "number" and int(s[0][1:]) % 7 == 0}
    known, sure = pii.learn(spark.createDataFrame(sorted(edges), "pattern string, instance string, shape string, n int"), 3, 0.6, 0.6)
    want = plain_learning(edges, 3, 0.6, 0.6)
    assert {(r["instance"], r["kind"]) for r in known.collect()} == want[0] and {(r["pattern"], r["kind"]) for r in sure.collect()} == want[1]
    assert len(want[0]) > sum(s[1] in pii.KINDS for s in shapes if any(e[1] == s[0] for e in edges))


def test_no_word_of_a_context_is_cut(spark):
    word = "w" * 5000
    rows = [(i, f"{word}a +1 (41{i}) 555-010{i} x") for i in range(4)] + [(10, f"{word}a 555 0100 77 y"), (11, f"{word}b 555 0100 77 y"), (12, "ip 10[.]0 [dot] 0[.]1 z")] + [(20 + i, f"ip 10.0.0.{i} z") for i in range(4)]
    rows += [(30, "mail " + "a" * 300 + " [at] " + "b" * 100 + " [dot] org now")] + [(40 + i, f"mail a{i}@b.org now") for i in range(4)]
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"] or []] for r in pii.find_pii(frame(spark, rows, "doc_id long, text string")).collect()}
    assert found[10] == [("phone", 5002, 5013)] and found[11] == [] and found[12] == [("ip", 3, 21)] and found[30] == [("email", 5, len(rows[-5][1]) - 4)]


# ------------------------------------------------------------------ mixing


@pytest.mark.parametrize("bucket_rows", [2000, 3])
def test_mix(spark, bucket_rows):
    rows = [r for r in corpus(11, 200)]
    sizes, docs = {}, with_clashes(frame(spark, rows))
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, todo, left = {}, set(order), 1.5 * sum(sizes.values())
    while todo:
        level = left / sum(weight[s] for s in todo)
        over = [s for s in todo if level * weight[s] > 2 * sizes[s]]
        for s in over or list(todo):
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
            todo.discard(s)
            left -= target[s] if over else 0
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    for s in order:
        part = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] for r in part)
        assert abs(sum(r["taken"] for r in part) - target[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), bucket_rows=bucket_rows).collect()), key=str)
    # the table has a column ``words`` of its own, which stays
    out = mixing.mixed_documents(docs.withColumn("words", F.lit("own")))
    assert out.columns == [*docs.columns, "repetition", "mix_words"]
    for r in out.collect():
        assert len(r["text"].encode().split()) == r["mix_words"] and r["words"] == "own"
    assert out.agg(F.sum("mix_words")).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ contamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_contamination(spark):
    rows = corpus(12)
    items = [(i, rows[i * 3][1][20:260]) for i in range(12)] + [(50, "The tide"), (51, "the TIDE!"), (52, None), (53, "??"), (54, "of"), (9, rows[5][1]), (55, "x" * 50), (7, rows[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("size", F.lit(2))
    want = []
    for r in rows:
        w = plain_words(r[1])
        hit, found = set(), set()
        for i, t in items:
            x = plain_words(t)
            n = min(10, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    for bits in (1 << 27, 64):
        f = decontaminate.contamination(with_clashes(frame(spark, rows)), bench, most_bloom_bits=bits)
        ids = F.coalesce("item_ids", F.array().cast("array<string>"))
        got = f.select("doc_id", "n_words", F.coalesce(decontaminate.covered(F.col("spans")), F.lit(0)), F.size(ids), F.sha2(F.concat_ws(",", ids), 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    none = decontaminate.contamination(frame(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(rows) and none.where("spans IS NOT NULL").count() == 0


# ------------------------------------------------------------------ quality


def plain_grams(text, order=5):
    s = b"\xff" * (order - 1) + text
    return [s[k : k + order] for k in range(len(text))]


class PlainModel:
    """The same model with dictionaries."""

    def __init__(self, texts, order=5):
        self.order, self.counts = order, {order: collections.Counter(g for t in texts for g in plain_grams(t, order))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.followers = {}, {}
        for k, c in self.counts.items():
            n = [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
            d = [0.5, 1.0, 1.5]
            if min(n) > 0:
                y = n[0] / (n[0] + 2 * n[1])
                e = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
                d = e if 0 < e[0] < 1 and 0 < e[1] < 2 and 0 < e[2] < 3 else d
            self.discounts[k] = [0, *d]
            for g, x in c.items():
                self.followers.setdefault((k, g[:-1]), []).append(x)

    def prob(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        peers, d = self.followers.get((k, gram[:-1])), self.discounts[k]
        if not peers:
            return self.prob(gram[1:])
        c = self.counts[k].get(gram, 0)
        return max(c - d[min(c, 3)], 0) / sum(peers) + sum(d[min(x, 3)] for x in peers) / sum(peers) * self.prob(gram[1:])


def test_model_is_a_distribution_and_matches_plain_counts(spark):
    texts = [b"abracadabra abra", "cad \u00e9abra brac".encode(), b"bad cab", b""]
    parts = [0, 1, 2, 3]
    df = spark.createDataFrame([(t.decode(), p) for t, p in zip(texts, parts, strict=True)] + [(None, 1)], "text string, part int")
    path = ngram_quality.kneser_ney(ngram_quality.gram_counts(df), scratch(spark, "model"))
    number = lambda g: int.from_bytes(g, "big")
    for m, own in enumerate(({0, 1}, {0}, {1}, {2, 3}, {2}, {3})):
        plain = PlainModel([t for t, p in zip(texts, parts, strict=True) if p in own])
        grams = sorted({g for t in texts for g in plain_grams(t)} | {b"zzzzz", b"abrzz", b"\xff\xff\xff\xffz"})
        got = ngram_quality.log_probabilities(path, np.array([number(g) for g in grams]))[:, m]
        assert np.allclose(np.exp(got), [plain.prob(g) for g in grams], rtol=1e-4)
        for context in (b"abra", b"zzzz", b"\xff\xff\xff\xff"):
            every = np.array([number(context + bytes([x])) for x in range(256)])
            assert abs(np.exp(ngram_quality.log_probabilities(path, every)[:, m].astype(float)).sum() - 1) < 1e-3


def plain_judgement(rows, labels, half, quantile, prior, least, caution):
    """Of each row (nats, heat, entropy, limit of the entropy, most heat); ``half`` has the half of each id."""
    trusted = {d for d, q, t in labels if q == 1 and not t and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None} - trusted
    body = lambda r: (r[1] or "").encode()
    of = lambda ids: PlainModel([body(r) for r in rows if r[0] in ids])
    models = [of({d for d in x if d in half and half[d] in h}) for x in (trusted, toxic) for h in ((0, 1), (0,), (1,))]

    def score(r, m, t=3):
        logs = [[math.log(x.prob(g)) for g in plain_grams(body(r))] for x in (models[m], models[t])]
        words = re.findall(rb"[^ \t\n\r\f\v]*[ \t\n\r\f\v]|[^ \t\n\r\f\v]+", body(r))
        at, heat = 0, []
        for w in words:
            heat.append(sum(logs[1][at : at + len(w)]) - sum(logs[0][at : at + len(w)]))
            at += len(w)
        return -sum(logs[0]), max(heat)

    unseen = {id(r): score(r, 2 if half[r[0]] == 0 else 1) for r in rows if r[0] in trusted and r[1]}
    mean = sum(unseen[id(r)][0] for r in rows if id(r) in unseen) / sum(len(body(r)) for r in rows if id(r) in unseen)
    entropy = lambda nats, r: (nats + prior * mean) / (len(body(r)) + prior)

    def cut(values):
        bins = sorted(math.floor(v * 1000) for v in values)
        return (next(b for k, b in enumerate(bins) if bisect.bisect_right(bins, b) >= len(bins) * quantile) + 1) / 1000

    used = [r for r in rows if id(r) in unseen]
    general = cut([entropy(unseen[id(r)][0], r) for r in used])
    mild = [math.floor(1000 * unseen[id(r)][1]) for r in used]
    hot = [math.floor(1000 * score(r, 0, 5 if half[r[0]] == 0 else 4)[1]) for r in rows if r[0] in toxic and r[1]]
    edges = sorted({*mild, *hot})
    costs = [(caution * sum(x > a for x in mild) / len(mild) + sum(x <= a for x in hot) / len(hot), -a, (a + 1 + b) / 2000) for a, b in zip(edges, edges[1:]) if sum(x > a for x in mild) <= max(ngram_quality.FEW, len(mild) * (1 - quantile))]
    assert min(costs)[0] < 1
    hottest = min(costs)[2]
    own = {lang: [entropy(unseen[id(r)][0], r) for r in used if r[2] == lang] for lang in {r[2] for r in rows}}
    limits = {lang: cut(values) if len(values) >= least else general for lang, values in own.items()}
    out = []
    for r in rows:
        nats, heat = score(r, 0) if r[1] else (None, None)
        out.append((nats, heat, entropy(nats, r) if r[1] else None, limits[r[2]], hottest))
    return out


@pytest.mark.parametrize("stretch", [4 << 20, 700])
def test_judge_is_that_of_plain_python(spark, stretch, monkeypatch):
    """Perplexity, heat, thresholds and verdicts of the query's operator, with ties at the threshold and a language of its own."""
    monkeypatch.setattr(ngram_quality, "STRETCH", stretch)
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(3, 40)), rng.choice(["en", "en", "de", None]), "a", 1) for i in range(90)]
    rows += [(200 + i, "%x" % rng.getrandbits(400), "en", "a", 1) for i in range(6)] + [(300 + i, f"you {w} of the sea", "en", "a", 1) for i, w in enumerate(["idiotic", "idiotic", "trashy", "trashy", "idiotic"])]
    rows += [(400, None, "en", "a", 1), (401, "", "en", "a", 1), (402, rows[3][1], "en", "a", 1), (None, rows[4][1], "de", "a", 1), (5, rows[5][1], rows[5][2], "a", 1)]
    labels = [(i, 1, 0) for i in range(70)] + [(i, 1, 1) for i in range(300, 304)] + [(3, 1, 0), (None, 1, 1), (85, 0, 1), (300, 1, 0), (86, None, None)]
    quantile, prior, least, caution = 0.9, 50.0, 20, 2.0
    docs, lab = with_clashes(frame(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["text_key"]): r for r in ngram_quality.judge(docs, lab, quantile, prior, least, caution).collect()}
    assert sum(1 for _ in rows) == ngram_quality.judge(docs, lab, quantile, prior, least, caution).count()

    key = {(r["doc_id"], r["text"]): (r["h"], r["k"]) for r in frame(spark, rows).select("doc_id", "text", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).alias("h"), F.xxhash64("text").alias("k")).collect()}
    half = {r[0]: key[r[0], r[1]][0] for r in rows}
    plain = plain_judgement(rows, labels, half, quantile, prior, least, caution)
    verdicts = set()
    for r, (nats, heat, entropy, limit, hottest) in zip(rows, plain, strict=True):
        g = got[r[0], key[r[0], r[1]][1]]
        n_tokens = len((r[1] or "").encode())
        assert g["threshold"] == pytest.approx(math.exp(limit), rel=1e-3) and g["n_tokens"] == n_tokens
        if not r[1]:
            assert not g["kept"] and g["perplexity"] is None and g["heat"] is None
            continue
        assert g["perplexity"] == pytest.approx(math.exp(nats / n_tokens), rel=1e-3) and g["heat"] == pytest.approx(heat, abs=1e-2)
        if abs(entropy - limit) > 2e-3 and abs(heat - hottest) > 2e-2:
            assert g["kept"] == (entropy <= limit and heat <= hottest)
            verdicts.add((g["kept"], entropy <= limit))
    assert verdicts == {(True, True), (False, True), (False, False)}


def test_groups_of_text_do_not_change_scores(spark):
    rows = corpus(3, 40)
    df = frame(spark, rows).coalesce(1)
    texts = df.select("text", (F.coalesce("doc_id", F.lit(0)) % 4).cast("int").alias("part"))
    path = ngram_quality.kneser_ney(ngram_quality.gram_counts(texts), scratch(spark, "model"))
    score = lambda **limits: sorted((str(r["doc_id"]), r["text_key"], r["n_tokens"], *np.round(r["nats"] + (r["heat"] or []), 6)) for r in ngram_quality.cross_entropies(df, path, True, **limits).collect())
    assert score() == score(group=400) == score(most_grams=100)


def test_one_odd_trusted_text_does_not_set_the_cut(spark):
    frame_of = lambda heats: spark.createDataFrame([(float(h),) for h in heats], "heat double")
    clean, toxic = [5 + k / 50 for k in range(200)], [27.0, 30.0, 33.0, 28.0]
    assert 9 < ngram_quality.heat_cut(frame_of([*clean, 38.8]), frame_of(toxic), 5.0, 0.998) < 27
    assert ngram_quality.heat_cut(frame_of(clean), frame_of([]), 5.0, 0.998) == float("inf")
    assert ngram_quality.heat_cut(frame_of(clean), frame_of(clean), 5.0, 0.998) == float("inf")  # nothing tells them apart
    # more than a few, and more than the quantile leaves: the cut goes above them
    assert ngram_quality.heat_cut(frame_of([*clean, *[28.2] * 11]), frame_of(toxic), 1.0, 0.998) > 28.2


def test_junk_goes_and_clean_text_stays(spark):
    rows = [r for r in corpus(13, 150)]
    junk = [(5000 + i, "".join(chr(33 + (i * 7 + k * k) % 60) for k in range(300)), "en", "a", 300) for i in range(10)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 140] + [(3, 1, 0), (None, 1, 0), (4, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = ngram_quality.judge(with_clashes(frame(spark, rows + junk)), labels, least=20)
    assert got.count() == len(rows + junk) and got.where("doc_id >= 5000 AND kept").count() == 0
    clean = got.where("doc_id < 150 AND n_tokens > 0")
    assert clean.where("kept").count() >= 0.97 * clean.count()
    assert got.where("n_tokens = 0 AND (kept OR perplexity IS NOT NULL)").count() == 0
    none = ngram_quality.judge(frame(spark, rows), labels.where("false"))
    assert none.where("NOT kept AND n_tokens > 0").count() == 0
    assert ngram_quality.judge(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_held_out_quality(spark):
    """Labels that are hidden from training are told apart."""
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    train, hidden = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = ngram_quality.judge(docs, train).join(hidden, "doc_id")
    rate = {r["quality"]: r["k"] for r in got.where("toxic = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.3


def test_hidden_toxic_labels(spark):
    """Fluent texts with insults go, though their labels are hidden; clean ones stay."""
    sf, insults = "/root/testdata/sf0.01", r"(?i)\b(idiot|moron|scum|clown|trash|worthless|pathetic|loser|disgusting|stupid)\b"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    got = ngram_quality.judge(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    got = got.join(docs.select("doc_id", F.col("text").rlike(insults).alias("insults")).dropDuplicates(["doc_id"]), "doc_id").where("quality = 1")
    kept = {(r["toxic"], r["insults"]): r["k"] for r in got.groupBy("toxic", "insults").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1, True] < 0.1 and kept[0, False] > 0.97


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns and after.count() <= before.count(), name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {tuple(x[k : k + min(10, len(x))]) for x in items for k in range(len(x) - min(10, len(x)) + 1)}
    for r in before.collect():
        w = plain_words(r["text"])
        assert not any(tuple(w[k : k + 10]) in wins for k in range(len(w) - 9))
    last = corpus_pipeline.STAGES[4][1](spark, before, SF)
    assert last.where("repetition > 2").count() == 0
    total = before.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(last.agg(F.sum("words")).first()[0] - 1.5 * total) <= 25


def test_pipeline_of_odd_rows(spark):
    rows = corpus(14, 40)
    docs = frame(spark, rows).withColumn("rid", F.lit(1)).withColumn("_key", F.lit("x"))
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:30]], "doc_id long, quality int, toxic int")
    kept = ngram_quality.judge(docs, labels)
    assert kept.count() == len(rows)
    lines = corpus_pipeline.line_deduplication(spark, docs, SF)
    assert lines.columns == docs.columns and lines.where("doc_id = 1004").count() <= 1
    near = corpus_pipeline.near_duplicate_removal(spark, docs, SF)
    assert near.select("doc_id").distinct().count() == near.count()
    assert set(corpus_pipeline.source_mixing(spark, docs, SF).columns) == {*docs.columns, "repetition", "words"}


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "The tide of the north harbour was high in year 12")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_nulls_in_any_column(spark, odd_folder, name, stage):
    empty = stage(spark, spark.createDataFrame([], SCHEMA), odd_folder)
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "   \n\t ", "en", "a", 5), (4, "some words that stay here for good", None, None, None), (4, "some words that stay here for good", None, None, None), (5, "x" * 300_000, "de", None, 7)]
    docs = frame(spark, rows).withColumn("label", F.lit(None).cast("string")).withColumn("words", F.lit("own"))
    out = stage(spark, docs, odd_folder)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns[:7] == docs.columns and {i for i, _ in kept} <= {None, 1, 2, 3, 4, 5}
    if name in ("near_duplicates", "lines"):
        assert sum(i == 4 for i, _ in kept) == 1
    if name == "near_duplicates":  # the three texts without words are one group, of the document with the smallest id
        assert sorted(i for i, _ in kept) == [1, 4, 5]


def test_very_long_texts(spark):
    """A text of over a megabyte, across the edges of what operators cut texts into."""
    from slickwake.llm import exact_dedup, simhash, suffix_dedup
    from tests.llm.test_dedup import brute_fingerprint, brute_repeats

    rng = random.Random(33)
    passage = sentence(rng, 45)
    body = " ".join("%x" % rng.getrandbits(40) for _ in range(100_000))
    edge = (1 << 20) - 120
    long = body[:edge] + passage + body[edge:]
    rows = [(1, long, "en", "a", 1), (2, "aa " + passage + " bb", "en", "b", 1), (3, long.encode().upper().decode(), "en", "a", 1), (4, body, "en", "a", 1)]
    docs = frame(spark, rows)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs.where("doc_id <> 4")).collect()), key=str)
    assert got == brute_repeats([r for r in rows if r[0] != 4], 200)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}
    near = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert all(near[r[0]]["fp"] % (1 << 64) == brute_fingerprint(r[1]) for r in rows) and near[3]["component_id"] == 1
    like = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert like == {1: 1, 2: 2, 3: 1, 4: 1}
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    hit = {r["doc_id"]: (r["n_words"], r["item_ids"]) for r in decontaminate.contamination(docs, items).collect()}
    assert hit == {r[0]: (len(plain_words(r[1])), ["7"] if r[0] != 4 else None) for r in rows}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {r[0]: len(r[1].split()) for r in rows}
