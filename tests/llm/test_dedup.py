import collections
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slickwake.llm import chunk_dedup, exact_dedup, line_dedup, simhash, suffix_dedup
from slickwake.llm.graph import components
from tests.llm.helpers import SCHEMA, corpus, frame, sentence, with_clashes


def ascii_lower(t):
    return (t or "").encode().lower()


# ------------------------------------------------------------------ exact


@pytest.mark.parametrize("max_bytes", [32 << 20, 2000])
def test_exact_groups(spark, max_bytes):
    rows = corpus()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[ascii_lower(r[1])].append(r[0])
    want = []
    for r in rows:
        ids = groups[ascii_lower(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(ascii_lower(r[1])).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(with_clashes(frame(spark, rows)), max_bytes=max_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_trie_spills_and_keeps_counts():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    trie, got = exact_dedup.PatriciaTrie(5000), collections.Counter()
    for i, k in enumerate(keys):
        trie.add(k, 1, i, i)
        while trie.bytes > 5000 and (cut := trie.spill()):
            got.update({k: e[0] for k, e in cut})
    got.update({k: e[0] for k, e in trie.walk()})
    assert got == collections.Counter(keys)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ substrings


def brute_repeats(rows, width):
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(b[k : k + width] for _, b in bodies for k in range(len(b) - width + 1))
    out = []
    for i, b in bodies:
        hit = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                hit[k : k + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, hit, strict=True) if not y)
        out.append((i, len(b), sum(hit), sum(1 for k in range(len(hit)) if hit[k] and not (k and hit[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [512, 1])
def test_repeated_strings(spark, few):
    rng = random.Random(5)
    passages = [sentence(rng, 40)[:n] for n in (199, 200, 201, 230)]
    rows = corpus(3, 40) + [(2000 + i, "".join(rng.choice([sentence(rng, 9), rng.choice(passages)[rng.randint(0, 40) :]]) for _ in range(5)), "en", "a", 1) for i in range(50)]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(with_clashes(frame(spark, rows)), few=few).collect()), key=str)
    assert got == brute_repeats(rows, 200)


def test_repeated_strings_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_boundaries(b, bits=5, least=24, most=512):
    """The rule of the docstring, byte by byte."""
    gear, h, spots, hs = chunk_dedup._GEAR.tolist(), 0, [], []
    for k, x in enumerate(b):
        h = (2 * h + gear[x]) & 0xFFFF
        hs.append(h)
        if h >> (16 - bits) == 0:
            spots.append(k + 1)
    ends = [x for k, x in enumerate(spots) if k == 0 and x >= 0 or k and x - spots[k - 1] >= least]
    ends = sorted({*ends, len(b)} - {0})
    out, last = [], 0
    for e in ends:
        while e - last > most:
            last = min(range(last + least, last + most + 1), key=lambda k: hs[k - 1])
            out.append(last)
        out.append(e)
        last = e
    return out


def test_chunks(spark):
    rows = corpus(4)
    docs, count = [], collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        ends = plain_boundaries(b)
        parts = [(a, e, b[a:e]) for a, e in zip([0, *ends], ends)]
        docs.append((r[0], b, parts))
        count.update(p[2] for p in parts)
    owner, want = {}, []
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for p in d[2]:
            owner.setdefault(p[2], (id(d), p[0]))
    for d in docs:
        i, b, parts = d
        runs, now = [], []
        for k, p in enumerate([*parts, None]):
            if p and count[p[2]] > 1:
                now.append((k, p))
            elif now:
                runs.append(now)
                now = []
        reach = lambda r: (parts[r[-1][0] + 1][1] if r[-1][0] + 1 < len(parts) else len(b)) - (parts[r[0][0] - 1][0] if r[0][0] else 0)  # noqa: B023, E731
        runs = [r for r in runs if r[-1][1][1] - r[0][1][0] >= 48 and reach(r) >= 240]
        want.append((i, len(b), len(parts), sum(r[-1][1][1] - r[0][1][0] for r in runs), sum(e - a for r in runs for _, (a, e, x) in r if owner[x] != (id(d), a))))
    size = lambda pieces: sum(p["stop"] - p["start"] for p in pieces or [])
    got = [(r["doc_id"], r["n_bytes"], r["n_chunks"], size(r["passages"]), size(r["removed"])) for r in chunk_dedup.chunk_dedup(with_clashes(frame(spark, rows))).collect()]
    # of rows that repeat id and text (and of null ids) any may be the owner
    plain = lambda rows: sorted((r for r in rows if r[0] not in (None, 1004)), key=str)
    assert plain(got) == plain(want)
    for i in (None, 1004):
        assert sorted(r[1:4] for r in got if r[0] == i) == sorted(r[1:4] for r in want if r[0] == i)
        assert sum(r[4] for r in got if r[0] == i) == sum(r[4] for r in want if r[0] == i)
    assert chunk_dedup.chunk_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_of_over_fifty_words_are_found_and_short_notices_stay(spark):
    rng = random.Random(21)
    rows, n = [], 60
    for k in range(n):
        passage = sentence(rng, 51)
        rows += [(10 * k + j, " ".join([sentence(rng, rng.randint(20, 60)), passage, sentence(rng, rng.randint(20, 60))]), "en", "a", 1) for j in range(2)]
        rows.append((10 * k + 5, sentence(rng, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + sentence(rng, 30), "en", "a", 1))
    got = {r["doc_id"]: r for r in chunk_dedup.chunk_dedup(frame(spark, rows)).collect()}
    found = sum(bool(got[10 * k]["passages"]) and bool(got[10 * k + 1]["removed"]) for k in range(n))
    assert found >= 0.95 * n
    assert sum(bool(got[10 * k + 5]["passages"]) for k in range(n)) == 0


def test_chunk_boundaries_resist_shifts():
    import numpy as np

    b = sentence(random.Random(1), 2000).encode()
    cut = lambda x: chunk_dedup.boundaries(np.frombuffer(x, np.uint8)).tolist()
    assert cut(b) == plain_boundaries(b)
    ends, moved = cut(b), cut(b[:1000] + b"inserted" + b[1000:])
    assert {e + 8 for e in ends if e > 1100} == {e for e in moved if e > 1108}
    assert np.diff(chunk_dedup.boundaries(np.zeros(5000, np.uint8)), prepend=0).max() <= 512
    periodic = b"all work, no play " * 300
    ends = cut(periodic)
    assert ends == plain_boundaries(periodic) and len({periodic[a:b] for a, b in zip(ends, ends[1:], strict=False)}) < 5


# ------------------------------------------------------------------ lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton(spark, edits):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
    df = spark.createDataFrame([(word(), word()) for _ in range(400)], "a string, b string")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("w")).collect():
        assert r["w"] == (distance(r["a"], r["b"]) <= edits)


def brute_lines(rows, edits=1, least=20):
    occ, lines = [], {}
    for k, r in enumerate(rows):
        for at, x in enumerate(r[1].split("\n") if r[1] is not None else []):
            x = x.strip(" \r\t")
            if x:
                occ.append(((r[0] is not None, r[0] or 0, k), at, x))
                lines.setdefault(x, len(lines))
    par = list(range(len(lines)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    names = list(lines)
    for i, a in enumerate(names):
        for j in range(i):
            if min(len(a), len(names[j])) >= least and abs(len(a) - len(names[j])) <= edits and distance(a, names[j]) <= edits:
                par[find(i)] = find(j)
    owner = {}
    for d, at, x in sorted(occ):
        owner.setdefault(find(lines[x]), (d, at))
    gone = collections.defaultdict(list)
    for d, at, x in occ:
        if owner[find(lines[x])] != (d, at):
            gone[d[1] if d[0] else None].append(at)
    return {d: sorted(v) for d, v in gone.items()}


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_lines(spark, edits):
    rng = random.Random(8)
    rows = [r for r in corpus(6, 30) if r[0] != 1004]
    base = "Page number 17 of this fine report of ours"
    for i in range(25):
        x = list(base)
        for _ in range(i % 3):
            k = rng.randrange(len(x))
            x[k : k + rng.choice([0, 1])] = rng.choice(["", "z", "é"])
        rows.append((3000 + i, "intro " + sentence(rng, 5) + "\n  " + "".join(x) + "\r\nshort\n\n", "en", "a", 1))
    want = brute_lines(rows, edits)
    got = collections.defaultdict(list)
    for r in line_dedup.duplicate_lines(with_clashes(frame(spark, rows)), edits).collect():
        got[r["doc_id"]] += r["dropped"] or []
    assert {d: sorted(v) for d, v in got.items() if v} == want
    if edits != 1:
        return
    d = line_dedup.duplicate_lines(frame(spark, rows)).where("doc_id IS NOT NULL").select("doc_id", "dropped", "n_lines")
    texts = {r[0]: r[1] for r in rows}
    for r in frame(spark, rows).join(d, "doc_id").select("doc_id", line_dedup.without_lines(F.col("text"), F.col("dropped")).alias("t")).collect():
        t = texts[r["doc_id"]]
        assert r["t"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(r["doc_id"], [])))


@pytest.mark.parametrize("edits, dense, block", [(1, 64, 512), (2, 64, 512), (2, 2, 3), (3, 3, 4)])
def test_line_links_of_crowded_buckets(spark, edits, dense, block):
    rng = random.Random(edits)
    lines = {f"Report {rng.randint(0, 99)} of the northern harbour, page {rng.randint(0, 99)}" for _ in range(60)} | {f"Report of {sentence(rng, 3)}" for _ in range(30)} | {"", "a", "ab", "abcd", "abce"}
    lines = sorted(lines)
    want = brute_components(lines, lambda a, b: abs(len(a) - len(b)) <= edits and distance(a, b) <= edits)
    got = {r["node"]: r["label"] for r in components(line_dedup.line_links(spark.createDataFrame([(x, x) for x in lines], "name string, line string"), edits, dense, block)).collect()}
    classes = lambda of: {frozenset(x for x in lines if of(x) == of(y)) for y in lines}
    assert classes(lambda x: got.get(x, x)) == classes(want.get)


def test_long_lines(spark):
    """Lines of 400,000 characters that differ by one are linked, in time that doesn't grow with the square of their length."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, "x" + base, "en", "a", 1), (2, "x" + base[:250_000] + "Z" + base[250_001:], "en", "a", 1), (3, "x" + base[:100] + base[101:], "en", "a", 1), (4, base[::-1], "en", "a", 1)]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got == {1: None, 2: [0], 3: [0], 4: None}


def test_lines_of_repeated_rows_and_empty_table(spark):
    rows = [(1, "a line that is long enough\nother words stand in this line", "en", "a", 1)] * 3
    got = sorted(len(r["dropped"] or []) for r in line_dedup.duplicate_lines(frame(spark, rows)).collect())
    assert got == [0, 2, 2]
    assert line_dedup.duplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ fingerprints


def brute_fingerprint(text, n=3):
    w = ascii_lower(text).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(nodes, linked):
    par = {n: n for n in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                par[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rows = corpus(9)
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[comp[f]] = min(r[0], least.get(comp[f], r[0]))
    want = sorted([(r[0], f"{f:016x}", least.get(comp[f])) for r, f in zip(rows, fps, strict=True)], key=str)
    found = simhash.near_duplicates(with_clashes(frame(spark, rows))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


@pytest.mark.parametrize("dense, level", [(128, None), (2, 1), (2, 3), (5, 5), (128, 2)])
def test_links_of_crowded_lists(spark, dense, level):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.choice([0, 1, 2, 3, 9, 17, 40, 41, 42, 63])
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["u"], r["v"]) for r in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense, level).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_near_duplicates_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def word_shingles(text, n=5):
    w = ascii_lower(text).split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("dense, block", [(64, 512), (3, 4)])
def test_similar_documents_are_those_of_brute_force(spark, dense, block):
    rng = random.Random(12)
    rows = corpus(12, 40)
    common = sentence(rng, 30)
    for i in range(12):  # near copies: 1 to 3 words changed, so similarities from 0.6 to 1
        base = sentence(rng, rng.randint(60, 120)).split()
        for k in range(5):
            w = list(base)
            for _ in range(k and rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(1000)
            rows.append((3000 + 5 * i + k, " ".join(w), "en", "a", 1))
        rows.append((4000 + i, sentence(rng, 40) + " " + common, "en", "a", 1))
        rows.append((4100 + i, common + " " + sentence(rng, 4), "en", "a", 1))
    sets = [word_shingles(r[1]) for r in rows]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    kinds = set(sets)
    assert sum(near(a, b) and 20 * len(a & b) < 19 * len(a | b) for a in kinds for b in kinds if a != b) > 20
    comp = brute_components(kinds, near)
    least = {}
    for r, s in zip(rows, sets, strict=True):
        if r[0] is not None:
            least[comp[s]] = min(r[0], least.get(comp[s], r[0]))
    want = sorted([(r[0], least.get(comp[s])) for r, s in zip(rows, sets, strict=True)], key=str)
    found = simhash.similar_documents(with_clashes(frame(spark, rows)), dense=dense, block=block).select("doc_id", "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_pipeline_drops_near_copies_at_eight_tenths(spark):
    import corpus_pipeline

    base = sentence(random.Random(13), 104).split()
    near, far = list(base), list(base)
    near[30] = near[70] = "other"  # 90 of 110 shingles
    far[20] = far[50] = far[80] = "other"  # 85 of 115
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate([base, near, far], 1)]
    kept = corpus_pipeline.near_duplicate_removal(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 300)
    links = list(zip(ids, ids[1:], strict=False)) + [(20_000, 20_001), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: min(ids) for i in ids} | {20_000: 20_000, 20_001: 20_000}
