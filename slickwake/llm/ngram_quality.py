"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is trained on all trusted texts (``quality = 1`` and not toxic).  Its tokens are bytes of UTF-8, all of them:
no alphabet is chosen and nothing is pruned.  A text begins after start symbols (0xFF, which UTF-8 doesn't use).

Counting is sharded: tasks count the n-grams of their texts, counts meet by n-gram, lower orders count distinct left
extensions, each n-gram is joined with the totals of its context (count, and how many followers occur once, twice, or
more) to get its discounted share, and with the probability of its suffix, from the lowest order up.  Probabilities and
what contexts leave to lower orders become one table of keys, sorted over range partitions in the folder that the
cluster shares.  It never passes through the driver.

Scoring is a join with that table by distinct n-gram.  A task holds its texts, gathers their distinct n-grams (and their
contexts and suffixes), and merges them with the sorted shards, one batch of rows at a time: each shard is read once for
``GROUP`` bytes of text or ``MOST_GRAMS`` distinct n-grams, which for input splits of usual size is once for each task.
What it holds is bounded by these two, not by the model.  Moving n-grams to the shards instead would shuffle a row for
almost every byte of text, since a document repeats few of its n-grams.

Thresholds are set by documents that a model hasn't seen: trusted documents are dealt into two halves by a hash of
their id, each half is scored by a model of the other, and everything is judged by the model of both.  All models are
columns of the same tables.

A document's cross-entropy is shrunk towards that of all trusted text by ``prior`` pseudo-tokens, so a sentence of three
words isn't judged by chance.  Documents above the ``quantile`` of trusted documents of their language are rejected.
Quantiles come from counts over a grid of 1/1000 nat, exact to the grid and the same in every run.  Languages with
fewer than ``least`` trusted documents (and the null language, if so) use the quantile of all.

Fluent text can still be toxic.  A further model is trained on the texts labelled toxic (and not trusted), and each text
is read word by word in windows of one word and the space after it: the ``heat`` of a text is the largest sum of log
likelihood ratios, toxic against trusted, that a window has.  The most heat that is kept is fitted to both classes, each
scored by models of the half that it isn't in: of the cuts that leave at most 1 - ``quantile`` of the trusted texts above
them (or ``FEW`` texts, if that is more), that with the least ``caution`` times the share of trusted texts above plus the
share of toxic texts below, in the middle between the texts on its two sides.  So a few odd trusted texts can't switch
the decision off, and a cut that costs more than it catches isn't made.  Without toxic labels there is no heat and nothing
is rejected by it.

Null and empty texts have no tokens, no perplexity, and are rejected.  Labels repeat without effect; contradicting
labels don't make a document trusted unless one of them does.  Without any trusted text nothing is rejected but
empty texts.  A text exactly at a threshold is kept.  Repeated rows are each judged, alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, bloom, byte_column, file_store, in_bloom, materialize, read_table, scratch, stretches

ORDER, SYMBOLS = 5, 256
START = b"\xff" * (ORDER - 1)
#: Columns of the tables: the models of all trusted text and of either half, and the same of toxic text.
MODELS = ("w", "a", "b", "t", "ta", "tb")
#: The pairs of models (by place) whose ratio is a heat: all, and each half of either class unseen.
HEATS = ((3, 0), (3, 1), (3, 2), (4, 0), (5, 0))
#: Bytes of text that are worked on at a time, and bytes and distinct n-grams that share one reading of the model.
STRETCH, GROUP, MOST_GRAMS = 4 << 20, 64 << 20, 1 << 20
#: Trusted texts that may be hotter than the cut, however few there are.
FEW = 10
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f\v"))


# ------------------------------------------------------------------ counting


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, as a number in base 256, and where each text's n-grams end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    s = np.frombuffer(b"".join(x for t in texts for x in (START, t)), np.uint8).astype(np.int64)
    n = max(0, len(s) - ORDER + 1)
    code = s[:n].copy()
    for k in range(1, ORDER):
        code <<= 8
        code |= s[k : k + n]
    # n-grams that end in the start symbols of the next text are left out
    ends = np.cumsum(sizes)
    gaps = (ends + (ORDER - 1) * np.arange(len(sizes)))[:-1]
    inside = np.ones(n, bool)
    inside[(gaps[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return code[inside], ends


def gram_counts(texts: DataFrame) -> DataFrame:
    """``code`` and its counts in each model, of n-grams of the highest order; ``texts`` has ``text`` and ``part`` (0 and 1
    for the halves of trusted text, 2 and 3 for those of toxic text)."""

    def count(batches):
        part: list[list[bytes]] = [[], [], [], []]
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 4
        size = 0

        def fold() -> None:
            for k in range(4):
                if part[k]:
                    codes, n = np.unique(gram_codes(part[k])[0], return_counts=True)
                    codes, at = np.unique(np.concatenate((held[k][0], codes)), return_inverse=True)
                    held[k] = codes, np.bincount(at, np.concatenate((held[k][1], n))).astype(np.int64)
                    part[k] = []

        for batch in batches:
            for t, k in zip(byte_column(batch, "text"), batch.column("part").to_pylist(), strict=True):
                part[k].append(t)
                size += len(t)
                if size > STRETCH:
                    fold()
                    size = 0
        fold()
        for k, (codes, n) in enumerate(held):
            for at in range(0, len(codes), 1 << 16):
                c = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k, np.int32)), pa.array(c), pa.array(n[at : at + (1 << 16)])], names=["part", "code", "n"])

    found = arrow_map(texts.select("part", "text"), count, "part int, code long, n long")
    of = lambda *parts: F.sum(F.when(F.col("part").isin(*parts), F.col("n")).otherwise(0))
    return found.groupBy("code").agg(of(0, 1).alias("w"), of(0).alias("a"), of(1).alias("b"), of(2, 3).alias("t"), of(2).alias("ta"), of(3).alias("tb"))


def _discounts(counts: DataFrame) -> dict[str, list[float]]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more; fixed ones where counts are too few to tell."""
    r = counts.agg(*(F.count_if(F.col(m) == k).alias(f"{m}{k}") for m in MODELS for k in (1, 2, 3, 4))).first()
    out = {}
    for m in MODELS:
        n, out[m] = [r[f"{m}{k}"] for k in (1, 2, 3, 4)], [0.5, 1.0, 1.5]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
            if all(0 < x < k for k, x in enumerate(d, 1)):
                out[m] = d
    return out


def _key(order: int, code: Column, context: bool = False) -> Column:
    """Keys of the model's table: n-grams by order, and contexts by the order that they are contexts of."""
    return code.bitwiseOR(F.lit((order + 8 * context) << 48))


def kneser_ney(grams: DataFrame, path: str) -> str:
    """Write the table of a model to ``path``: ``key`` and a number for each of ``MODELS``, sorted by key in each file.

    For n-grams that is the interpolated probability of the last byte, for contexts the share that they leave to the
    next lower order.
    """
    orders, counts = {}, materialize(grams, "grams")
    for order in range(ORDER, 0, -1):
        d = _discounts(counts)
        off = {m: F.when(F.col(m) == 0, 0.0).when(F.col(m) == 1, d[m][0]).when(F.col(m) == 2, d[m][1]).otherwise(d[m][2]) for m in MODELS}
        totals = counts.groupBy(F.shiftright("code", 8).alias("context")).agg(*(F.sum(m).alias(f"total_{m}") for m in MODELS), *(F.sum(off[m]).alias(f"free_{m}") for m in MODELS))
        share = [F.coalesce(F.try_divide(F.col(m) - off[m], F.col(f"total_{m}")), F.lit(0.0)).alias(f"share_{m}") for m in MODELS]
        rest = [F.coalesce(F.try_divide(F.col(f"free_{m}"), F.col(f"total_{m}")), F.lit(1.0)).alias(f"rest_{m}") for m in MODELS]
        shares = counts.join(totals, F.shiftright("code", 8) == F.col("context")).select("code", *share, *rest)
        contexts = totals.select(_key(order, F.col("context"), True).alias("key"), *(r.alias(m) for r, m in zip(rest, MODELS, strict=True)))
        orders[order] = shares, contexts
        lower = F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
        if order > 1:
            counts = materialize(counts.groupBy(lower.alias("code")).agg(*(F.count_if(F.col(m) > 0).alias(m) for m in MODELS)), "grams")
    table, below = None, None
    for order in range(1, ORDER + 1):
        shares, contexts = orders[order]
        if below is None:
            known = shares.select("code", *((F.col(f"share_{m}") + F.col(f"rest_{m}") / SYMBOLS).alias(m) for m in MODELS))
        else:
            suffix = shares["code"].bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            known = shares.join(below.withColumnRenamed("code", "suffix"), suffix == F.col("suffix")).select("code", *((F.col(f"share_{m}") + F.col(f"rest_{m}") * F.col(m)).alias(m) for m in MODELS))
        below = materialize(known, "known")
        part = below.select(_key(order, F.col("code")).alias("key"), *MODELS).union(contexts)
        table = part if table is None else table.union(part)
    table.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    return path


# ------------------------------------------------------------------ scoring


def fetch(path: str, keys: np.ndarray) -> np.ndarray:
    """The model's rows at sorted distinct ``keys``, NaN where it has none, by a merge with its sorted files."""
    store, base = file_store(path)
    out = np.full((len(keys), len(MODELS)), np.nan, np.float32)
    for info in store.get_file_info(fs.FileSelector(base)):
        if len(keys) and info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as src:
                for batch in pq.ParquetFile(src).iter_batches(1 << 18):
                    own = batch.column("key").to_numpy()
                    a, b = np.searchsorted(keys, own[0]), np.searchsorted(keys, own[-1], "right")
                    at = np.searchsorted(own, keys[a:b])
                    hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == keys[a:b])
                    out[a + hit] = np.stack([batch.column(m).to_numpy() for m in MODELS], axis=1)[at[hit]]
    return out


def log_probabilities(path: str, codes: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of sorted distinct n-grams in each model."""
    grams, places = [codes], []
    for order in range(ORDER - 1, 0, -1):
        suffixes, at = np.unique(grams[-1] & ((1 << 8 * order) - 1), return_inverse=True)
        grams.append(suffixes)
        places.append(at)
    grams.reverse()
    places.reverse()
    contexts = [np.unique(g >> 8, return_inverse=True) for g in grams]
    keys = [g | (k << 48) for k, g in enumerate(grams, 1)] + [c | (k + 8 << 48) for k, (c, _) in enumerate(contexts, 1)]
    values = np.split(fetch(path, np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])
    p = np.full((1, len(MODELS)), 1 / SYMBOLS, np.float32)
    for k, g in enumerate(grams):
        below = p[places[k - 1]] if k else np.broadcast_to(p, (len(g), len(MODELS)))
        known, rest = values[k], values[ORDER + k][contexts[k][1]]
        p = np.where(np.isnan(known), np.where(np.isnan(rest), 1, rest) * below, known)
    return np.log(p)


def distinct_grams(texts: list[bytes]) -> np.ndarray:
    return np.sort(pd.unique(gram_codes(texts)[0]))


def text_scores(texts: list[bytes], grams: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the nats in the models of trusted text, and its heats (NaN without tokens); ``logs`` are those of ``grams``."""
    nats, heat = np.zeros((len(texts), 3)), np.full((len(texts), len(HEATS)), np.nan)
    codes, ends = gram_codes(texts)
    if len(codes):
        place, own = pd.factorize(codes)
        found = logs[np.searchsorted(grams, own)]
        has = np.flatnonzero(np.diff(ends, prepend=0))
        starts = np.concatenate(([0], ends[:-1]))[has]
        words = np.unique(np.concatenate((starts, 1 + np.flatnonzero(_SPACE[codes[:-1] & 255]))))
        of_word = np.searchsorted(words, starts)
        for m in range(3):
            nats[has, m] = -np.add.reduceat(found[place, m], starts, dtype=np.float64)
        for k, (toxic, trusted) in enumerate(HEATS):
            ratio = found[:, toxic] - found[:, trusted]
            heat[has, k] = np.maximum.reduceat(np.add.reduceat(ratio[place], words, dtype=np.float64), of_word)
    return nats, heat


def cross_entropies(docs: DataFrame, path: str, with_heat: bool, group: int = GROUP, most_grams: int = MOST_GRAMS) -> DataFrame:
    """``doc_id, text_key, lang, n_tokens, nats, heat`` for each row; ``nats`` has a sum for the model of all trusted text and
    of either half, ``heat`` the ratios of ``HEATS`` (null for empty texts and without a model of toxic text)."""

    def score(batches):
        held: list[tuple[pa.RecordBatch, list[bytes]]] = []
        grams, size = np.zeros(0, np.int64), 0

        def told():
            logs = log_probabilities(path, grams) if len(grams) else np.zeros((0, len(MODELS)), np.float32)
            for rows, texts in held:
                nats, heat = text_scores(texts, grams, logs)
                hot = [None if not with_heat or np.isnan(h[0]) else h for h in heat]
                own = [rows.column(c) for c in ("doc_id", "text_key", "lang")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(t) for t in texts], pa.int64()), pa.array(list(nats), pa.list_(pa.float64())), pa.array(hot, pa.list_(pa.float64()))], names=["doc_id", "text_key", "lang", "n_tokens", "nats", "heat"])

        for batch in batches:
            all_texts, rows = byte_column(batch, "text"), batch.select(["doc_id", "text_key", "lang"])
            for first, end in stretches(all_texts, STRETCH):
                texts = all_texts[first:end]
                grams = np.union1d(grams, distinct_grams(texts))
                held.append((rows.slice(first, end - first), texts))
                size += sum(map(len, texts))
                if size > group or len(grams) > most_grams:
                    yield from told()
                    held, grams, size = [], np.zeros(0, np.int64), 0
        yield from told()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("lang").cast("string"), "text")
    return arrow_map(rows, score, "doc_id long, text_key long, lang string, n_tokens long, nats array<double>, heat array<double>")


# ------------------------------------------------------------------ judging


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(good & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def toxic_ids(labels: DataFrame) -> DataFrame:
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull())
    return toxic.select(F.col("doc_id").cast("long").alias("toxic_id")).distinct()


def _taught_texts(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """Texts of ``docs`` with the columns of ``taught`` (by ``taught_id``).

    A Bloom filter of the ids (of bounded size) leaves most other texts where they are; the join decides.  It is a merge
    join at every size: a broadcast while ids are few would only hide what this costs later.
    """
    n = taught.count()
    maps, bits = bloom(taught.select(F.lit(0).alias("kind"), F.xxhash64("taught_id").alias("h")), n)
    shared = docs.sparkSession.sparkContext.broadcast(maps.get(0))

    def keep(batches):
        for b in batches:
            yield b.select(["doc_id", "text"]).filter(pa.array(in_bloom(shared.value, bits, b.column("h").to_numpy())))

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    near = arrow_map(rows, keep, "doc_id long, text string") if n else rows.select("doc_id", "text").where("false")
    return near.join(taught.hint("merge"), F.col("doc_id") == F.col("taught_id"))


def heat_cut(clean: DataFrame, toxic: DataFrame, caution: float, quantile: float) -> float:
    """The most heat that is kept, in the middle between two occupied bins of 1/1000; infinite if no cut is worth what it costs."""
    binned = lambda df, name: df.where("heat IS NOT NULL").groupBy(F.floor(F.col("heat") * 1000).alias("bin")).agg(F.count("*").alias(name))
    bins = binned(clean, "clean").join(binned(toxic, "toxic"), "bin", "full").na.fill(0, ["clean", "toxic"])
    # as many rows as there are heats, in thousandths
    up, all_ = Window.orderBy("bin"), Window.partitionBy()
    total = F.sum("clean").over(all_)
    above = total - F.sum("clean").over(up)
    under = F.try_divide(F.sum("toxic").over(up), F.sum("toxic").over(all_))
    costs = bins.select("bin", F.lead("bin").over(up).alias("next"), (caution * F.try_divide(above, total) + under).alias("cost"), (above <= F.greatest(F.lit(FEW), total * (1 - quantile))).alias("fits"))
    costs = costs.where("next IS NOT NULL AND cost < 1 AND fits")
    best = costs.orderBy("cost", F.desc("bin")).first()
    return (best["bin"] + 1 + best["next"]) / 2000 if best else float("inf")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, prior: float = 50.0, least: int = 100, caution: float = 5.0) -> DataFrame:
    """``doc_id, text_key, lang, n_tokens, perplexity, threshold, heat, kept``, one row per row of ``docs``."""
    trusted = materialize(trusted_ids(labels), "trusted")
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int")
    toxic = toxic_ids(labels).join(trusted, F.col("toxic_id") == F.col("trusted_id"), "left_anti")
    taught = materialize(trusted.select(F.col("trusted_id").alias("taught_id"), F.lit(False).alias("is_toxic")).union(toxic.select("toxic_id", F.lit(True))), "taught")
    texts = _taught_texts(docs, taught).select("text", F.when(F.col("is_toxic"), half + 2).otherwise(half).alias("part"))
    model = kneser_ney(gram_counts(texts), scratch(docs.sparkSession, "model"))
    scored = materialize(cross_entropies(docs, model, not taught.where("is_toxic").isEmpty()), "scores")

    # a trusted document's nats are those of the half that it isn't in
    is_trusted = F.col("doc_id") == F.col("trusted_id")
    unseen = lambda c: F.when(half == 0, F.col(c)[2]).otherwise(F.col(c)[1])
    of_trusted = scored.join(trusted, is_trusted, "left_semi").where("n_tokens > 0").withColumn("nats", unseen("nats")).withColumn("heat", unseen("heat"))
    of_toxic = scored.join(taught.where("is_toxic"), F.col("doc_id") == F.col("taught_id"), "left_semi").withColumn("heat", F.when(half == 0, F.col("heat")[4]).otherwise(F.col("heat")[3]))
    scored = scored.withColumn("nats", F.col("nats")[0]).withColumn("heat", F.col("heat")[0])
    mean = of_trusted.agg((F.sum("nats") / F.sum("n_tokens")).alias("m")).first()["m"] or 0.0
    entropy = (F.col("nats") + F.lit(prior * mean)) / (F.col("n_tokens") + F.lit(prior))
    language = F.coalesce("lang", F.lit("\0"))
    grid = of_trusted.groupBy(language.alias("language"), F.floor(entropy * 1000).alias("bin")).agg(F.count("*").alias("n"))

    def cut(by: list[str]) -> DataFrame:
        """The smallest grid point with ``quantile`` of the trusted documents below it, and how many there are."""
        run = Window.partitionBy(*by).orderBy("bin")
        bins = grid.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        up = bins.withColumn("up", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
        return up.where(F.col("up") >= F.col("all") * quantile).groupBy(*by).agg(((F.min("bin") + 1) / 1000).alias("cut"), F.first("all").alias("n"))

    pooled = cut([]).first()
    general = float(pooled["cut"]) if pooled and pooled["cut"] is not None else float("inf")
    most_heat = heat_cut(of_trusted, of_toxic, caution, quantile)
    own = cut(["language"]).where(F.col("n") >= least).select(F.col("language").alias("l"), "cut")
    limit = F.coalesce("cut", F.lit(general))
    return scored.join(own, language == F.col("l"), "left").select(
        "doc_id",
        "text_key",
        "lang",
        "n_tokens",
        F.when(F.col("n_tokens") > 0, F.exp(F.col("nats") / F.col("n_tokens"))).alias("perplexity"),
        F.exp(limit).alias("threshold"),
        "heat",
        ((F.col("n_tokens") > 0) & (entropy <= limit) & (F.coalesce("heat", F.lit(float("-inf"))) <= most_heat)).alias("kept"),
    )


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "kept")
