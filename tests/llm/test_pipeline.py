"""The pipeline, stage by stage and as a whole, against plain Python on a small table."""

import collections
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from slickwake.llm import mixing
from tests.llm.helpers import SCHEMA, frame, sentence
from tests.llm.test_dedup import brute_components, brute_lines, word_shingles
from tests.llm.test_others import plain_judgement, plain_words

NOTICE = "This line stands in a great many of these documents for all to see"


def documents(rng):
    """Clean texts, junk, insults, repeated lines, near copies and passages of the benchmark; every id once."""
    item = sentence(rng, 14)
    rows = [(i, "\n".join(sentence(rng, rng.randint(6, 25)) for _ in range(rng.randint(1, 3))), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100 + i, "".join(chr(33 + (i * 7 + k * k) % 60) for k in range(200)), "en", "a") for i in range(4)]
    rows += [(200 + i, f"{sentence(rng, 9)} {w} {sentence(rng, 9)}", "en", "b") for i, w in enumerate(["wickedest", "wickedly", "wickedness", "wicked", "wickeder"])]
    rows += [(300 + i, f"{sentence(rng, 12)}\n{NOTICE}{'s' if i == 2 else ''}", "de", "c") for i in range(4)] + [(310, NOTICE, "de", "c")]
    rows += [(400 + i, rows[i][1] + " more words", rows[i][2], "c") for i in range(5)]
    rows += [(500 + i, f"{sentence(rng, 8)} {item} {sentence(rng, 8)}", "en", "a") for i in range(3)]
    rows += [(600, None, "en", "a"), (601, "", None, "b"), (602, "  \n ", "de", None)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows], [(1, item), (2, "too short"), (3, None)]


def plain_stages(rows, items, labels, half):
    """What each stage but the last keeps, as {id: text}."""
    plain = plain_judgement([(r[0], r[1], r[2]) for r in rows], labels, half, 0.998, 50.0, 100, 5.0)
    docs = {r[0]: r[1] for r, (_, heat, entropy, limit, most) in zip(rows, plain, strict=True) if r[1] and entropy <= limit and heat <= most}
    yield docs

    order = [r for r in rows if r[0] in docs]
    gone = brute_lines(order)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in docs.items()}
    docs = {i: t for i, t in cut.items() if i not in gone or re.search(r"\S", t)}
    yield docs

    sets = {i: word_shingles(t) for i, t in docs.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4
    group, least = brute_components(docs, alike), {}
    for i in sorted(docs):
        least.setdefault(group[i], i)
    docs = {i: t for i, t in docs.items() if least[group[i]] == i}
    yield docs

    wins = set()
    for _, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    hit = lambda w: any(tuple(w[k : k + len(x)]) == x for x in wins for k in range(len(w) - len(x) + 1))
    yield {i: t for i, t in docs.items() if not hit(plain_words(t))}


def test_pipeline_is_that_of_plain_python(spark, tmp_path):
    rng = random.Random(77)
    rows, items = documents(rng)
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(4)] + [(100, 0, 0)]
    folder = str(tmp_path)
    frame(spark, [(i, t, lang, source, n) for i, t, lang, source, n in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).alias("h")).collect()}
    before = {r[0]: r[1] for r in rows}
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows, items, labels, half), strict=False):
        docs = stage(spark, docs, folder).cache()
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(got) and got == want, name
        assert want != before, f"{name} has nothing to do"
        before = want
    assert set(before).isdisjoint({*range(100, 104), *range(200, 205), *range(500, 503), 310, 600, 601, 602}) and len(set(before) & set(range(60))) >= 58

    # the mix takes of each document what the operator says, in whole texts but for the last repetition
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    out = corpus_pipeline.run(spark, folder).collect()
    words = collections.Counter()
    for r in out:
        whole = before[r["doc_id"]].split()
        words[r["doc_id"]] += r["words"]
        assert r["text"].split() == whole[: r["words"]] and (r["words"] == len(whole) or r["repetition"] == -(-taken[r["doc_id"]] // len(whole)))
    assert words == taken and len({(r["doc_id"], r["repetition"]) for r in out}) == len(out)
