"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of a text's words (lower-cased, with an edge mark on either side), present
or absent. From the labelled texts come document counts by class; the log-count ratio of an n-gram,
``log((p + a) / |p|) - log((q + a) / |q|)``, scales its feature, and a regularised logistic regression learns
a weight for it (Wang and Manning, "Baselines and Bigrams", 2012). Only n-grams in enough labelled texts and
with a strong enough ratio are kept, so the model is a small table whatever the corpus.

Class counts and weights are fitted on at most ``max_positive`` and ``max_negative`` labelled texts, chosen
by a hash of the id. Scoring runs over all whole texts. Labels, languages, sources and ids are never inputs.

Null and empty texts have no features and score the intercept. A text that is labelled twice is used once,
as toxic if either label says so; null labels are no labels. Repeated documents are rows of their own.
Without labels of both classes every score is one constant, near the share of positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayfare.llm.words import owners, slices, spread, texts_of, words_of
from wayfare.plans.shared import cut

SIZES = (3, 4, 5, 6)
MAX_POSITIVE, MAX_NEGATIVE = 2000, 5000
MIN_TEXTS, MIN_RATIO, MAX_FEATURES = 3, 0.7, 30_000
SMOOTH, RIDGE, ROUNDS = 0.5, 2e-4, 400


def ngrams(word: str, sizes: tuple[int, ...] = SIZES) -> set[str]:
    marked = f"\x02{word}\x03"
    return {marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)}


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text to be toxic; each n-gram counts once for each text."""
        names = list(self.weights)
        index = {g: i for i, g in enumerate(names)}
        w = np.array([self.weights[g] for g in names] or [0.0])
        words = words_of(texts, lower=True)
        hits, ends = _features(words.dictionary.to_pylist(), index)
        found, offsets = spread(ends, hits, words.codes, words.offsets)
        pairs = np.unique(owners(offsets) * max(1, len(names)) + found)
        total = np.bincount(pairs // max(1, len(names)), weights=w[pairs % max(1, len(names))], minlength=len(texts))
        return 1 / (1 + np.exp(-(total + self.intercept)))


def _features(words: list[str], index: dict[str, int], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """The indexed n-grams of each word, as one array and its offsets."""
    flat: list[int] = []
    ends = np.zeros(len(words) + 1, dtype=np.int64)
    get = index.get
    for at, word in enumerate(words):
        marked = f"\x02{word}\x03"
        long = len(marked)
        for n in sizes:
            for i in range(long - n + 1):
                found = get(marked[i : i + n])
                if found is not None:
                    flat.append(found)
        ends[at + 1] = len(flat)
    return np.array(flat, dtype=np.int64), ends


def fit(rows: list[np.ndarray], labels: np.ndarray, names: list[str], ratio: np.ndarray) -> Model:
    """Learn weights from the feature numbers of each text and its label (1: toxic). Deterministic."""
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        return Model({}, float(np.log((positive + 1) / (n - positive + 1))))
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64)
    scaled = ratio[column]
    w, bias = np.zeros(len(names)), float(np.log(positive / (n - positive)))
    step, bias_step = np.zeros(len(names)), 0.0
    # Each class weighs as much as the other, so 0.5 parts them whatever their shares.
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (n - positive))
    for _ in range(ROUNDS):
        z = np.bincount(owner, weights=scaled * w[column], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) * weight
        gradient = np.bincount(column, weights=scaled * error[owner], minlength=len(names)) + RIDGE * w
        step += gradient**2
        bias_step += error.sum() ** 2
        w -= 0.1 * gradient / (np.sqrt(step) + 1e-8)
        bias -= 0.1 * error.sum() / (np.sqrt(bias_step) + 1e-8)
    return Model(dict(zip(names, (w * ratio).tolist(), strict=True)), bias)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, negative, positive): in how many texts of each label an n-gram is, summed over some texts."""
    for batch in slices(batches, size=2 << 20):
        words = words_of(texts_of(batch), lower=True)
        index: dict[str, int] = {}
        flat: list[int] = []
        ends = np.zeros(len(words.dictionary) + 1, dtype=np.int64)
        for at, word in enumerate(words.dictionary.to_pylist()):
            flat.extend(index.setdefault(g, len(index)) for g in ngrams(word))
            ends[at + 1] = len(flat)
        found, offsets = spread(ends, np.array(flat, dtype=np.int64), words.codes, words.offsets)
        pairs = np.unique(owners(offsets) * max(1, len(index)) + found)
        toxic = batch.column("toxic").to_numpy()[pairs // max(1, len(index))]
        gram = pairs % max(1, len(index))
        both = [np.bincount(gram[toxic == y], minlength=len(index)) for y in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), *map(pa.array, both)], names=["gram", "negative", "positive"])


def _feature_rows(names: list[str]):
    index = {g: i for i, g in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=2 << 20):
            words = words_of(texts_of(batch), lower=True)
            hits, ends = _features(words.dictionary.to_pylist(), index)
            found, offsets = spread(ends, hits, words.codes, words.offsets)
            rows = [np.unique(found[a:b]).astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    """Fit on the bounded sample. ``labels``: (doc_id, toxic).

    Executors count the n-grams; the driver gets the kept ones, at most ``MAX_FEATURES``, and the numbers of
    those each sampled text has.
    """
    by_doc = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ranked = by_doc.withColumn("h", F.xxhash64("doc_id"))
    chosen = [ranked.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n).select("doc_id", "toxic") for y, n in ((1, max_positive), (0, max_negative))]
    sample = chosen[0].union(chosen[1])  # bounded by the two parameters, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = cut(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text")))
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return fit([], np.repeat([1, 0], [positive, negative]), [], np.zeros(0))
    share = lambda c, n: F.log((F.col(c) + SMOOTH) / (n + 2 * SMOOTH))
    grams = texts.mapInArrow(_count_grams, "gram string, negative long, positive long").groupBy("gram").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    rated = grams.withColumn("n", F.col("negative") + F.col("positive")).withColumn("ratio", share("positive", positive) - share("negative", negative))
    kept = rated.where((F.col("n") >= MIN_TEXTS) & (F.abs("ratio") >= MIN_RATIO)).orderBy((-F.abs("ratio") * F.sqrt("n")), "gram").limit(MAX_FEATURES).select("gram", "ratio").toPandas().sort_values("gram")
    names = kept["gram"].tolist()
    got = texts.mapInArrow(_feature_rows(names), "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")
    rows = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in got["features"]]
    return fit(rows, got["toxic"].to_numpy().astype(np.int64), names, kept["ratio"].to_numpy())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.scores(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row of ``docs`` (doc_id, text). One pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double, predicted int")


def remainder(key: str, modulus: int):
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def toxicity_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Train on labels whose id leaves a remainder other than 0, score everything; held_out marks remainder 0."""
    model = train(docs, labels.where(remainder("doc_id", modulus) != 0))
    scored = toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
