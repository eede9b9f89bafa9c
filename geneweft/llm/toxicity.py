"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, heads of words (their first bytes, which inflected forms share), pairs
of neighbours, and pairs with one or two words between them.
Each coordinate has its own learning rate, from the sum of its squared gradients, and an L1 threshold that holds weak
coordinates at exactly zero, so that the fitted model is a short list of (feature, weight) which travels to every task.

The model is fitted in one task on at most ``PER_CLASS`` documents of each class, whole texts. Scoring reads every text.

Defined cases: empty and null texts score by the bias alone; repeated rows score alike; without labelled rows of both
classes every score is 0.5; an empty table gives an empty result; other columns are kept and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.llm.labelled import sample
from geneweft.llm.textblocks import WordHasher, blocks, letters_only, mix

BITS = 24
PER_CLASS = 3000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 8
#: A feature is learned from this many documents on.
LEAST = 4
GAPS, HEADS = (1, 2, 3), (4, 5, 6, 7)
_KINDS = np.random.default_rng(7).integers(1, 1 << 62, 1 + len(GAPS) + len(HEADS), dtype=np.uint64)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def features(words: np.ndarray, heads: list[np.ndarray]) -> np.ndarray:
    """Hashed features of a text's words and of their heads, repeats included."""
    with np.errstate(over="ignore"):
        found = [mix(x + kind) for x, kind in zip([words, *heads], _KINDS[len(GAPS) :])]
        for gap, kind in zip(GAPS, _KINDS):
            if len(words) > gap:
                found.append(mix(words[:-gap] * np.uint64(3) + words[gap:] * np.uint64(5) + kind))
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


def text_features(texts) -> Iterator[np.ndarray]:
    """Features of every text."""
    hasher = WordHasher(letters_only())
    for _, held in blocks(texts):
        (words, *heads), offsets = hasher.heads(held, HEADS)
        for a, b in zip(offsets, offsets[1:]):
            yield features(words[a:b], [x[a:b] for x in heads])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, label, features (packed distinct int32)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [np.unique(x).tobytes() for x in text_features(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "features": packed})

    return docs.mapInPandas(run, "doc_id bigint, label int, features binary")


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, weights and bias after ``epochs`` passes over (features, label) examples, in a fixed mixed order."""
    known, seen = np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *(x for x, _ in examples)]), return_counts=True)
    known = known[seen >= LEAST]
    rows = [(np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]), y) for x, y in examples]
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    bias = len(known)
    mixed = np.random.default_rng(1)

    def weights(at, z_at):
        shrunk = np.sign(z_at) * np.maximum(np.abs(z_at) - np.where(at == bias, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for i in mixed.permutation(len(rows)):
            x, y = rows[i]
            at = np.append(x, bias)
            w = weights(at, z[at])
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - rate * w
            n[at] += gradient**2
    every = np.arange(len(known) + 1)
    w = weights(every, z)
    kept = np.flatnonzero(w[:-1])
    return known[kept], w[kept], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows for which ``allowed`` (a column of ``labels``) holds."""

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "features"])
        rows = [(np.frombuffer(x, dtype=np.int32), y) for x, y in zip(group["features"], group["label"])]
        if len(set(group["label"])) < 2:
            rows = []
        found, weights, bias = ftrl(rows)
        return pd.DataFrame({"feature": np.append(found, -1), "weight": np.append(weights, bias)})

    rows = document_features(sample(docs, labels, label, allowed, per_class))
    fitted = rows.withColumn("all", F.col("label") - F.col("label")).groupBy("all").applyInPandas(train, "feature bigint, weight double").toPandas().sort_values("feature")
    known = fitted[fitted["feature"] >= 0]
    bias = fitted.loc[fitted["feature"] < 0, "weight"].sum()
    return Model(known["feature"].to_numpy(np.int32), known["weight"].to_numpy(np.float64), float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        weighted = np.zeros(1 << BITS, dtype=bool)
        weighted[model.features] = True
        for texts in batches:
            sums = np.full(len(texts), model.bias)
            for i, found in enumerate(text_features(texts)):
                found = np.unique(found[weighted[found]])
                if len(found):
                    sums[i] += model.weights[np.searchsorted(model.features, found)].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(into, scored(F.col(text)))
