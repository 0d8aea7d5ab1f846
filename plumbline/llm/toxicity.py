"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 64-bit hashes of its lower-cased words, of neighbouring pairs
and of pairs with one word between. The model is fitted on a bounded sample of labelled documents
(`SAMPLE` rows, the smallest by a hash of their id, so the same on every run): features that occur
in fewer than `MIN_TEXTS` distinct sampled texts are never admitted, each coordinate has a learning
rate of its own, and L1 leaves few weights other than zero. Those are written as a table, are
bounded by the sample, and go to every task as two small arrays. Scoring is one pass over whole
texts without a shuffle.

Defined results: a null or wordless text has the score of the bias alone; labels that disagree on
one id count as toxic; null labels, labels without a document and rows without doc_id (which are
scored, never learnt) are left out of learning. Without any label every score is 0.5. Repeated rows
get equal scores; learning counts equal texts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import settle, text_or_empty, texts

# Bound of the labelled sample that the model is fitted on.
SAMPLE = 8192
EPOCHS = 6
MIN_TEXTS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.01
THRESHOLD = 0.7
# Words whose hashes a worker keeps.
CACHED = 100_000

WORD = re.compile(r"\w+").findall
# Odd multipliers that make a pair's hash depend on the order and the distance of its words.
NEXT, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxh64_intdigest(word.encode())
        return value


HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = WORD(text.lower())
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def features(words: np.ndarray) -> np.ndarray:
    """Hashes of words, pairs and skip-pairs, repeats included."""
    turned = words * NEXT
    pairs = turned[:-1] ^ (words[1:] + NEXT)
    skips = (turned[:-2] + SKIP) ^ (words[2:] * SKIP)
    return np.concatenate([words, pairs, skips])


def fit(samples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, min_texts: int = MIN_TEXTS,
        alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and weights other than zero; the first of them, hash 0, is the bias."""
    found = [np.unique(features(w)) for w in samples]
    every = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, int)
    counts = np.diff(np.append(heads, len(every)))
    admitted = every[heads[counts >= min_texts]]
    rows = []
    for own in found:
        at = np.searchsorted(admitted, own)
        at[at == len(admitted)] = 0
        rows.append(np.append(at[admitted[at] == own] + 1 if len(admitted) else at[:0], 0))
    z, n = np.zeros(len(admitted) + 1), np.zeros(len(admitted) + 1)
    free = np.full(len(z), l1)
    free[0] = 0.0  # the bias is not penalised

    def weights(at) -> np.ndarray:
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) <= free[at], 0.0, (np.sign(z[at]) * free[at] - z[at]) / rate)

    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    w = weights(slice(None))
    kept = np.flatnonzero(w[1:])
    return np.append(np.uint64(0), admitted[kept]), np.append(w[0], w[1:][kept])


class Model:
    """Weights as sorted arrays, with a small table that rules most features out."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes[1:])
        self.bias = float(weights[0]) if len(weights) else 0.0
        self.hashes, self.weights = hashes[1:][order], weights[1:][order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True

    def score(self, text: str) -> float:
        own = features(word_hashes(text))
        own = np.unique(own[self.seen[own & np.uint64((1 << 20) - 1)]])
        total = self.bias
        if len(own) and len(self.hashes):
            at = np.searchsorted(self.hashes, own)
            at[at == len(self.hashes)] = 0
            total += float(self.weights[at[self.hashes[at] == own]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, **settings) -> DataFrame:
    """Weights (feature long, weight double) from the labelled documents for which `usable` holds.

    `labels` has doc_id and toxic; `usable` is a condition on doc_id.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "toxic": batch["toxic"],
                                "words": [word_hashes(t).tobytes() for t in batch["text"]]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once: dict[bytes, int] = {}
        for batch in batches:
            for words, toxic in zip(batch["words"], batch["toxic"], strict=True):
                once[words] = max(once.get(words, 0), int(toxic))
        rows = [np.frombuffer(words, np.uint64) for words in once]
        hashes, weights = fit(rows, np.array(list(once.values()), float), **settings)
        yield pd.DataFrame({"feature": hashes.view(np.int64), "weight": weights})

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id"))
    picked = known.orderBy("place", "doc_id").limit(sample)
    # The sample is bounded by `sample`, and so is what is broadcast and what the one fitting task gets.
    rows = texts(docs).join(F.broadcast(picked), "doc_id").mapInPandas(hashed, "place long, toxic int, words binary")
    return rows.repartition(1).sortWithinPartitions("place", "words").mapInPandas(fitted, "feature long, weight double")


def _arrays(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The weights on the driver, the bias first; they are bounded by the sample they are from."""
    listed = weights.toPandas().sort_values("feature", key=lambda f: f != 0, kind="stable")
    return listed["feature"].to_numpy(np.int64).view(np.uint64), listed["weight"].to_numpy(float)


def score(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    hashes, values = _arrays(weights)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(hashes, values)
        for batch in batches:
            scores = [model.score(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores,
                                "predicted": [int(s >= threshold) for s in scores]})

    return texts(docs).mapInPandas(scored, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from those not held out."""
    weights = settle(learn(docs, labels, ~held_out(), sample), "ftrl-weights")
    return score(docs, weights, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    hashes, values = _arrays(settle(learn(docs, labels, ~held_out(), sample), "ftrl-weights"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(hashes, values)
        for texts_ in batches:
            yield texts_.map(model.score).astype(float)

    return docs.where(scored(text_or_empty()) < threshold)
