"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms.  A word counts for itself and for its beginnings of 3 to 8 bytes, since insults are inflected and compounded.  The
vocabulary has the ``terms`` that are most surely commoner in toxic examples (log-likelihood ratio) and the
``background`` commonest words, which give each text's language and style a place in the space and its length a weight.
Weights are ``(1 + ln tf) * idf`` over unit length; document frequencies are counted over all documents.

Examples.  At most ``examples`` labelled texts, the first by a hash of the text: the documented bound of what is fitted.
Equal texts are one example, with the mean of their labels.

Index.  Examples are sorted by their strongest background terms, so that texts of one kind stand together, and cut into
blocks.  For each term of a block the index has a posting list (place in the block, weight) and its largest weight.  Its
size is at most ``examples * (terms + background)`` weights, so it is sent to tasks as it is.

Search.  A batch of documents gets an upper bound for each block, the sum of query weights times block maxima.  Blocks are
read only for documents whose bound reaches the similarity of their ``nearest``-th best so far, each document's best block
first.  So the ``nearest`` examples are those that comparing with all would give (similarities to a millionth; ties to the
example with the smaller number).

Score.  Neighbours vote with their cosine as weight, and ``prior`` further votes have the rate of toxic examples.  Votes
become probabilities by a logistic curve, fitted to the votes that each example gets from the others.  A score is a
function of the text and of what was taught: equal texts get equal scores, whatever their id, language or label.

Defined results: null and empty texts, and texts without any term, have no neighbours and the score of the prior votes
alone; without labels everything scores 0; labels of rows that have no document, or null, teach nothing; a null id is
neither held out nor taught.  Repeated rows are scored one by one, alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwake.llm.common import arrow_map, byte_column, materialize, read_table
from slickwake.llm.decontaminate import words_of

BLOCK, BATCH = 64, 512
PREFIXES, LONGEST = range(3, 9), 32
#: Similarities count to a millionth; places break ties.
_GRID, _PLACES = 1_000_000, 1 << 20


def terms_of(word: bytes) -> list[bytes]:
    """A word's terms: its beginnings, and the whole of it after an equals sign."""
    found = [word[:k] for k in PREFIXES if len(word) > k]
    return [*found, b"=" + word] if len(word) <= LONGEST else found


class Lookup(dict):
    """Words with the numbers of their terms in the vocabulary; forgets when it gets large."""

    def __init__(self, vocabulary: dict[bytes, int], most: int = 1 << 17) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = [self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary]
        return found


def term_counts(texts: list[bytes], lookup: Lookup) -> np.ndarray:
    """Counts of the vocabulary's terms, a row for each text."""
    out = np.zeros((len(texts), len(lookup.vocabulary)), np.float32)
    for k, t in enumerate(texts):
        found = np.fromiter(chain.from_iterable(map(lookup.__getitem__, words_of(t))), np.int64)
        out[k] = np.bincount(found, minlength=out.shape[1])
    return out


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0).astype(np.float32)


@dataclass
class Model:
    """What tasks need: the vocabulary, its weights, and the index of examples."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    best: np.ndarray  # largest weight of each term in each block
    blocks: list[tuple[np.ndarray, np.ndarray]]  # of each block the terms, and their postings as columns
    ids: list  # of examples, in the order of the index
    labels: np.ndarray
    rate: float
    curve: tuple[float, float] = (0.0, 1.0)


# ------------------------------------------------------------------ teaching


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def taught_examples(docs: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``examples`` distinct labelled texts."""
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("taught_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("h", F.xxhash64("text"))
    # ids and hashes decide which texts are examples; texts move only once they are chosen
    named = rows.select("doc_id", "h").join(told, F.col("doc_id") == F.col("taught_id"))
    chosen = named.groupBy("h").agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("first")).orderBy("h").limit(examples).withColumnRenamed("h", "chosen")
    of = rows.join(F.broadcast(chosen), (F.col("h") == F.col("chosen")) & (F.col("doc_id") == F.col("first")))  # ``examples`` rows at most
    return of.groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("toxic").alias("toxic"))


def vocabulary_of(taught: DataFrame, terms: int, background: int) -> list[bytes]:
    """The commonest words, then the terms that mark toxic examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, list[float]] = {}
        for b in batches:
            for text, toxic in zip(byte_column(b, "text"), b.column("toxic").to_pylist(), strict=True):
                for t in {t for w in set(words_of(text)) for t in terms_of(w)}:
                    both = n.setdefault(t, [0.0, 0.0])
                    both[0] += 1
                    both[1] += toxic
        found = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([n[t][0] for t in found], pa.float64()), pa.array([n[t][1] for t in found], pa.float64())], names=["term", "n", "toxic"])

    counts = materialize(arrow_map(taught.select("text", "toxic"), count, "term binary, n double, toxic double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("n >= 2"), "terms")
    total = taught.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    common = counts.where(F.expr("startswith(term, X'3D')")).orderBy(F.desc("n"), "term").limit(background)
    out = [bytes(r["term"]) for r in common.collect()]
    n, bad = float(total["n"] or 0), float(total["toxic"] or 0)
    if 0 < bad < n:
        part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
        t, c, all_ = F.col("toxic"), F.col("n") - F.col("toxic"), F.col("n")
        sure = 2 * (part(t, F.lit(bad)) + part(bad - t, F.lit(bad)) + part(c, F.lit(n - bad)) + part(n - bad - c, F.lit(n - bad)) - part(all_, F.lit(n)) - part(n - all_, F.lit(n)))
        # sure to one in a thousand, and twice as common at least
        marks = counts.where((F.col("toxic") >= 2) & (t / bad > 2 * c / (n - bad))).withColumn("sure", F.round(sure, 6)).where("sure > 10.83")
        have = set(out)
        out += [m for r in marks.orderBy(F.desc("sure"), "term").limit(terms).collect() if (m := bytes(r["term"])) not in have]
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and how many of them have each term."""
    numbers = {t: k for k, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, rows, df = Lookup(shared.value), 0, np.zeros(len(shared.value), np.int64)
        for b in batches:
            texts = byte_column(b, "text")
            rows += len(texts)
            for k in range(0, len(texts), BATCH):
                df += np.count_nonzero(term_counts(texts[k : k + BATCH], lookup), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(df))], pa.int32()), pa.array([rows, *df.tolist()], pa.int64())], names=["term", "n"])

    found = {r["term"]: r["n"] for r in arrow_map(docs.select("text"), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(vocabulary))], np.float64)


def build_index(taught: DataFrame, vocabulary: list[bytes], idf: np.ndarray, background: int) -> Model:
    """The index of examples, made from vectors that tasks compute."""
    numbers = {t: k for k, t in enumerate(vocabulary)}
    shared = taught.sparkSession.sparkContext.broadcast((numbers, idf))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, idf = shared.value
        lookup = Lookup(numbers)
        for b in batches:
            v = unit_vectors(term_counts(byte_column(b, "text"), lookup), idf)
            at = [np.flatnonzero(x) for x in v]
            lists = [pa.array(at, pa.list_(pa.int32())), pa.array([x[k] for x, k in zip(v, at, strict=True)], pa.list_(pa.float32()))]
            # kinds of text by their strongest background terms
            kind = [np.argsort(-x[:background], kind="stable")[:3].astype(np.int32) for x in v]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("h"), *lists, pa.array(kind, pa.list_(pa.int32()))], names=["doc_id", "toxic", "h", "terms", "weights", "kind"])

    rows = arrow_map(taught.select("doc_id", "toxic", "h", "text"), vectors, "doc_id long, toxic double, h long, terms array<int>, weights array<float>, kind array<int>").orderBy("kind", "h").collect()  # bounded by ``examples``
    labels = np.array([r["toxic"] for r in rows], np.float64)
    best, blocks = [], []
    for first in range(0, len(rows), BLOCK):
        of = rows[first : first + BLOCK]
        postings = np.zeros((len(vocabulary), len(of)), np.float32)
        for k, r in enumerate(of):
            postings[r["terms"], k] = r["weights"]
        best.append(postings.max(axis=1))
        has = np.flatnonzero(best[-1])
        blocks.append((has, postings[has]))
    width = np.array(best, np.float32).T if best else np.zeros((len(vocabulary), 0), np.float32)
    return Model(numbers, idf, width, blocks, [r["doc_id"] for r in rows], labels, float(labels.mean()) if len(labels) else 0.0)


# ------------------------------------------------------------------ search


def nearest_examples(queries: np.ndarray, model: Model, nearest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the similarities (0 for none) and places of its ``nearest`` examples, best first, and the number of
    block readings."""
    n, read = len(queries), 0
    # one number for similarity and place: larger is nearer, and of equals the smaller place
    best = np.full((n, nearest), -1, np.int64)
    bound = queries @ model.best
    first = bound.argmax(axis=1) if bound.shape[1] else np.zeros(n, np.int64)
    for turn in (True, False):
        for b, (terms, postings) in enumerate(model.blocks):
            least = best[:, -1] // _PLACES / _GRID
            rows = np.flatnonzero((bound[:, b] > 0) & ((first == b) == turn) & (bound[:, b] + 3e-6 >= least))
            if not len(rows):
                continue
            read += len(rows)
            near = queries[np.ix_(rows, terms)] @ postings
            places = b * BLOCK + np.arange(postings.shape[1])
            keys = np.rint(near.astype(np.float64) * _GRID).astype(np.int64)
            keys = np.where(keys > 0, keys * _PLACES + (_PLACES - 1 - places), -1)
            both = np.concatenate((best[rows], keys), axis=1)
            top = np.partition(both, -nearest, axis=1)[:, -nearest:]
            best[rows] = -np.sort(-top, axis=1)
    found = best >= 0
    return np.where(found, best // _PLACES / _GRID, 0.0), np.where(found, _PLACES - 1 - best % _PLACES, -1), read


def votes(similarity: np.ndarray, places: np.ndarray, model: Model, prior: float) -> np.ndarray:
    label = np.where(places >= 0, model.labels[np.maximum(places, 0)], 0.0) if len(model.labels) else np.zeros_like(similarity)
    return ((similarity * label).sum(axis=1) + prior * model.rate) / (similarity.sum(axis=1) + prior)


def logistic(vote: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of the logistic curve through votes and labels (Newton steps, ridge of one on the slope's distance from 10)."""
    x = np.stack((np.ones_like(vote), vote), axis=1)
    beta = np.array([-5.0, 10.0])
    ridge, centre = np.diag([0.01, 0.01]), beta.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (label - p) - ridge @ (beta - centre))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def search(docs: DataFrame, model: Model, nearest: int, prior: float, others: bool = False) -> DataFrame:
    """``doc_id, text_key, vote, near``, one row per row of ``docs``; ``near`` has the nearest examples (id, similarity, label).

    ``others`` leaves out the example that a text itself is, for rows that are examples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup, own = Lookup(model.vocabulary), {i: k for k, i in enumerate(model.ids)}
        for b in batches:
            texts, ids = byte_column(b, "text"), b.column("doc_id").to_pylist()
            for at in range(0, len(texts), BATCH):
                q = unit_vectors(term_counts(texts[at : at + BATCH], lookup), model.idf)
                near, places, _ = nearest_examples(q, model, nearest + others)
                if others:
                    self_ = places == np.array([own.get(i, -2) for i in ids[at : at + BATCH]])[:, None]
                    self_[:, -1] |= ~self_.any(axis=1)
                    order = np.argsort(self_, axis=1, kind="stable")[:, :nearest]
                    near, places = np.take_along_axis(near, order, 1), np.take_along_axis(places, order, 1)
                vote = votes(near, places, model, prior)
                evidence = [[(model.ids[p], float(s), float(model.labels[p])) for s, p in zip(x, y, strict=True) if p >= 0] for x, y in zip(near[:, :3].tolist(), places[:, :3].tolist(), strict=True)]
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.float64())]))
                told = [[{"doc_id": i, "similarity": s, "label": y} for i, s, y in e] for e in evidence]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(at, len(q)) for c in ("doc_id", "text_key")] + [pa.array(vote), pa.array(told, kind)], names=["doc_id", "text_key", "vote", "near"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return arrow_map(rows, score, "doc_id long, text_key long, vote double, near array<struct<doc_id:long,similarity:double,label:double>>")


def teach(docs: DataFrame, labels: DataFrame, terms: int = 1024, background: int = 256, examples: int = 4096, nearest: int = 25, prior: float = 1.0) -> Model:
    """The model of the labelled rows of ``docs``, which are all rows that ``labels`` names."""
    taught = materialize(taught_examples(docs, labels, examples), "examples")
    vocabulary = vocabulary_of(taught, terms, background)
    n, df = document_frequencies(docs, vocabulary)
    model = build_index(taught, vocabulary, np.log((1 + n) / (1 + df)) + 1, background)
    if 0 < model.rate < 1:
        own = search(taught, model, nearest, prior, others=True).join(taught.select(F.col("doc_id").alias("i"), "toxic"), F.col("doc_id") == F.col("i")).select("vote", "toxic", "i").orderBy("i").toArrow()  # bounded by ``examples``
        model.curve = logistic(own.column("vote").to_numpy(), own.column("toxic").to_numpy())
    else:
        model.curve = (math.log(max(model.rate, 1e-9) / max(1 - model.rate, 1e-9)), 0.0)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, nearest: int = 25, prior: float = 1.0, **settings) -> DataFrame:
    """``doc_id, text_key, score, near``, one row per row of ``docs``."""
    model = teach(docs, labels, nearest=nearest, prior=prior, **settings)
    offset, slope = model.curve
    return search(docs, model, nearest, prior).select("doc_id", "text_key", F.round(1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("vote")))), 6).alias("score"), "near")


def op12_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.transform("near", lambda x: x["doc_id"]).alias("evidence"))
