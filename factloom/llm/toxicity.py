"""Toxicity classifier with counterfactual regularisation.

A logistic model over word and word-beginning features. Training also takes the labelled
sentences that mention an identity group, swaps the mention for another group of its kind,
and penalises the squared change of the score: a neutral mention of a group must not count.

Fitting uses a bounded sample of the labelled documents, ``max_rows`` of them, those of the
smallest id hashes. Feature counts over the sample are one aggregation; only features whose
rate differs between the classes by ``min_z`` standard deviations, and the identity words,
enter the model, ``max_features`` at most (the strongest). What reaches the driver is the
sample's vectors over those features. Scoring reads every whole text, in Arrow batches, and
shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (3, 4, 5, 6)
CACHE_WORDS = 200_000
VECTORS = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.int32())),
                     ("swaps", pa.list_(pa.string()))])

# fixed values: mentions of groups by kind; a mention is swapped within its kind and language
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "refugee", "foreigner", "native"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def features_of(word: str) -> list[str]:
    """The whole word (marked) and its beginnings."""
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swaps_of(text: str | None, terms: Sequence[Sequence[str]]) -> Iterator[tuple[str, str]]:
    """(mention, replacement) for each sentence and identity term it mentions."""
    group_of = {w: group for group in terms for w in group}
    for sentence in SENTENCE.findall(text.lower()) if text else ():
        for word in WORD.findall(sentence):
            for other in group_of.get(word, ()):
                if other != word:
                    yield word, other


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + math.fsum(map(self.word, words_of(text))), -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Callable, max_rows: int,
                  doc_id: str, text: str, label: str) -> DataFrame:
    """``text, label`` of the sample. ``held_out(id column)`` says which ids stay out.

    An id labelled twice counts with its smallest label; NULL ids and labels are left out. A
    document that repeats in ``docs`` repeats in the sample.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    sample = known.filter(~held_out(F.col("_id"))).orderBy(
        F.xxhash64("_id"), "_id").limit(max_rows)
    # bounded by max_rows
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(sample), "_id").select("text", "label")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str | None, int]]]:
    for batch in batches:
        yield list(zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _labelled(batches):
        toxic, clean = Counter(), Counter()
        for text, label in rows:
            seen = {f for w in words_of(text) for f in features_of(w)}
            (toxic if label else clean).update(seen)
        names = sorted(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
             pa.array([clean[n] for n in names], pa.int64())], names=["feature", "toxic", "clean"])


def select_features(rows: DataFrame, min_z: float, min_docs: int, max_features: int) -> list[str]:
    """Features whose share of toxic and of clean documents differs most, by z score."""
    total = rows.agg(F.sum("label").alias("toxic"), F.count("label").alias("n")).first()
    toxic, n = float(total["toxic"] or 0), float(total["n"])
    clean = n - toxic
    if not toxic or not clean:
        return []
    counted = rows.mapInArrow(_count_features, "feature string, toxic long, clean long").groupBy(
        "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + F.col("clean")) / n
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(
        share * (1 - share) * (1 / toxic + 1 / clean))
    strong = counted.filter((F.col("toxic") + F.col("clean") >= min_docs) & (share < 1)).select(
        "feature", F.abs(z).alias("z")).filter(F.col("z") >= min_z)
    return [r["feature"] for r in strong.orderBy(F.desc("z"), "feature").limit(max_features).collect()]


def _vectors(index: dict[str, int], terms: Sequence[Sequence[str]]):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _labelled(batches):
            out = []
            for text, label in rows:
                own = Counter(index[f] for w in words_of(text) for f in features_of(w) if f in index)
                swapped = [f"{a} {b}" for a, b in sorted(set(swaps_of(text, terms)))]
                out.append({"label": label, "at": sorted(own), "value": [own[k] for k in sorted(own)],
                            "swaps": swapped})
            yield pa.RecordBatch.from_pylist(out, VECTORS)
    return vectors


def fit_weights(label: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray,
                width: int, pairs: list[tuple[dict[int, float], float]], l2: float,
                counterfactual: float, steps: int) -> tuple[float, np.ndarray]:
    """Accelerated gradient descent on the penalised mean log loss.

    ``rows, at, value`` are the entries of the document vectors; ``pairs`` are feature
    differences of swapped mentions with how many documents hold them.
    """
    n = max(1, len(label))
    pair_row = np.array([i for i, (d, _) in enumerate(pairs) for _ in d], dtype=int)
    pair_at = np.array([k for d, _ in pairs for k in d], dtype=int)
    pair_value = np.array([v for d, _ in pairs for v in d.values()], dtype=float)
    pair_weight = np.array([c for _, c in pairs], dtype=float) / n
    # a bound of the curvature: Gershgorin on the entries
    norm = np.bincount(rows, value * value, n).max(initial=0.0)
    squares = np.bincount(pair_row, pair_value * pair_value, len(pairs)) if len(pairs) else np.zeros(0)
    rate = 1.0 / (0.25 * (norm + 1) + l2 + 2 * counterfactual * float(squares @ pair_weight))
    weights, bias = np.zeros(width), 0.0
    looked, looked_bias = weights.copy(), bias
    for step in range(steps):
        margin = np.bincount(rows, looked[at] * value, n) + looked_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / n
        slope = np.bincount(at, error[rows] * value, width) + l2 * looked
        if len(pairs):
            change = np.bincount(pair_row, looked[pair_at] * pair_value, len(pairs)) * pair_weight
            slope += 2 * counterfactual * np.bincount(pair_at, change[pair_row] * pair_value, width)
        new, new_bias = looked - rate * slope, looked_bias - rate * error.sum()
        push = step / (step + 3)
        looked, looked_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    return bias, weights


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable, max_rows: int = 20_000,
        min_z: float = 4.0, min_docs: int = 5, max_features: int = 20_000, l2: float = 1e-5,
        counterfactual: float = 10.0, steps: int = 1500,
        terms: Sequence[Sequence[str]] = IDENTITY_TERMS, doc_id: str = "doc_id",
        text: str = "text", label: str = "toxic") -> Model:
    """Learn the model from at most ``max_rows`` labelled documents that are not held out.

    Without labels of both classes the model scores every text with the rate of the one
    class there is (0.5 without any), smoothed so that it is neither 0 nor 1.
    """
    spark = docs.sparkSession
    rows = written(training_rows(docs, labels, held_out, max_rows, doc_id, text, label),
                   scratch(spark, "toxic-sample"))
    chosen = select_features(rows, min_z, min_docs, max_features)
    named = sorted({f"={w}" for group in terms for w in group} | set(chosen))
    index = {f: k for k, f in enumerate(named)}
    # row order depends on the partitioning: sums must not
    got = sorted(map(tuple, rows.mapInArrow(
        _vectors(index, terms), "label int, at array<int>, value array<int>, swaps array<string>").collect()))
    y = np.array([label for label, *_ in got], dtype=float)
    if y.sum() in (0, len(y)):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(rate / (1 - rate))), {})
    row = np.repeat(np.arange(len(got)), [len(a) for _, a, _, _ in got])
    at = np.array([k for _, a, _, _ in got for k in a], dtype=int)
    value = np.array([x for _, _, v, _ in got for x in v], dtype=float)
    pairs = []
    for swap, held in sorted(Counter(s for *_, swaps in got for s in swaps).items()):
        before, after = swap.split(" ")
        change: Counter = Counter(index[f] for f in features_of(after) if f in index)
        change.subtract(index[f] for f in features_of(before) if f in index)
        pairs.append(({k: float(v) for k, v in change.items() if v}, float(held)))
    bias, weights = fit_weights(y, row, at, value, len(named), pairs, l2, counterfactual, steps)
    return Model(float(bias), {f: float(w) for f, w in zip(named, weights) if w})


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text",
          name: str = "score") -> DataFrame:
    """``keep`` and the score (0 to 1) of every row; NULL and empty texts get the bias alone.

    Whole texts are read. Each word's weight is looked up once per task and kept in a table of
    bounded size. Columns not named are not read; ``name`` is the score's.
    """
    own_text = [] if text in keep else [text]
    source = docs.select(*keep, *own_text)
    schema = source.drop(*own_text).withColumn(name, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                margins = []
                for content in part.column(text).to_pylist():
                    parts = []
                    for word in words_of(content) if model.weights else ():
                        weight = known.get(word)
                        if weight is None:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            weight = known[word] = model.word(word)
                        if weight:
                            parts.append(weight)
                    margins.append(model.bias + math.fsum(parts))
                scores = 1 / (1 + np.exp(-np.clip(np.array(margins, dtype=float), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(scores)], names=[*keep, name])
    return source.mapInArrow(scored, schema)


def crc_held_out(folds: int = 5) -> Callable:
    """Ids whose crc32 (of the id as text) is divisible by ``folds``."""
    return lambda column: F.crc32(column.cast("string")) % folds == 0

