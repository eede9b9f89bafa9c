"""Quality scores by histogram gradient-boosted trees over statistics of a document.

Each text becomes a row of numbers: shares of kinds of characters, shapes of words and lines, and how much repeats. The
trees are grown on binned columns with gradient histograms and stored as flat arrays, one row per tree and one column per
node of a complete binary tree, so that numpy walks all documents of a batch down a tree in ``DEPTH`` steps.

The model is fitted on at most ``PER_CLASS`` labelled documents of each class (their statistics, a few MB). Statistics
and scores are computed for every whole text.

Defined cases: empty and null texts have the statistics of an empty text and a score of their own; repeated rows score
alike; without labelled rows of both classes every score is 0.5; an empty table gives an empty result; other columns are
kept and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geneweft.llm.labelled import sample
from geneweft.llm.textblocks import WordHasher, blocks, space_separated

PER_CLASS = 6000
BINS, DEPTH, TREES, RATE, LAMBDA, LEAST = 64, 4, 80, 0.15, 1.0, 20
#: Byte classes: lower case, upper case, digit, outside ASCII, blank, line end, other space, then single marks.
MARKS = b".,!?;:|#*$%&@/\\<>()[]{}\"'-_=+"
CLASSES = 8 + len(MARKS)
OTHER = 7


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.int64)
    table[97:123], table[65:91], table[48:58], table[128:256] = 0, 1, 2, 3
    table[32], table[10] = 4, 5
    table[[9, 11, 12, 13]] = 6
    for i, mark in enumerate(MARKS):
        table[mark] = 8 + i
    return table


COLUMNS = 14 + CLASSES


def statistics(texts) -> np.ndarray:
    """One row of ``COLUMNS`` numbers for every text."""
    hasher, table = WordHasher(space_separated()), byte_classes()
    out = np.zeros((len(texts), COLUMNS), dtype=np.float32)
    for start, held in blocks(texts):
        words, offsets = hasher(held)
        sizes = np.array([len(x) for x in held])
        owner = np.repeat(np.arange(len(held)), sizes)
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        counts = np.bincount(owner * CLASSES + table[data], minlength=len(held) * CLASSES).reshape(-1, CLASSES)
        for i, raw in enumerate(held):
            n, size = offsets[i + 1] - offsets[i], max(1, len(raw))
            own, times = np.unique(words[offsets[i] : offsets[i + 1]], return_counts=True)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            sentences = counts[i, 8] + counts[i, 10] + counts[i, 11]
            letters = counts[i, 0] + counts[i, 1] + counts[i, 3]
            seen = max(1, len(lines))
            out[start + i] = np.concatenate([
                [
                    np.log1p(len(raw)), np.log1p(n), (size - counts[i, 4:7].sum()) / max(1, n), len(own) / max(1, n),
                    times.max(initial=0) / max(1, n), np.square(times / max(1, n)).sum(), (times > 1).mean() if len(times) else 0,
                    len(lines), 1 - len(set(lines)) / seen, np.log1p(len(raw) / seen), sentences / max(1, n),
                    counts[i, 1] / max(1, letters), letters / size, counts[i, 7:].sum() / max(1, n),
                ],
                counts[i] / size,
            ])
    return out


@dataclass(frozen=True)
class Trees:
    column: np.ndarray  # (trees, inner nodes)
    above: np.ndarray  # (trees, inner nodes): larger values go right
    leaf: np.ndarray  # (trees, leaves)
    base: float


def raw_scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), trees.base)
    rows = np.arange(len(x))
    for column, above, leaf in zip(trees.column, trees.above, trees.leaf):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, column[node]] > above[node])
        total += leaf[node - len(column)]
    return total


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for 0/1 labels with Newton steps on the logistic loss."""
    if len(set(y.tolist())) < 2:
        inner = 2**DEPTH - 1
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    # classes weigh alike, so that 0.5 parts them
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    total, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        column, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            cells = ((node - first)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            histogram = lambda v: np.bincount(cells, np.repeat(v, x.shape[1]), count * x.shape[1] * BINS).reshape(count, x.shape[1], BINS)  # noqa: B023, E731
            gs, hs, ns = np.cumsum(histogram(g), 2), np.cumsum(histogram(h), 2), np.cumsum(histogram(np.ones(len(y))), 2)
            part = lambda a, b: a * a / (b + LAMBDA)
            gain = part(gs, hs) + part(gs[..., -1:] - gs, hs[..., -1:] - hs) - part(gs[..., -1:], hs[..., -1:])
            gain[(ns < LEAST) | (ns[..., -1:] - ns < LEAST)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-9 and b < len(edges[c]):
                    column[first + k], above[first + k] = c, edges[c][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > above[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + LAMBDA)
        total += value[leaf]
        trees.append((column, above, value))
    return Trees(*(np.stack(part) for part in zip(*trees)), 0.0)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = PER_CLASS) -> Trees:
    """Fit on labelled rows for which ``allowed`` (a column of ``labels``) holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [row.tobytes() for row in statistics(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "row": packed})

    rows = sample(docs, labels, label, allowed, per_class).mapInPandas(run, "doc_id bigint, label int, row binary").toPandas()
    rows = rows.sort_values(["doc_id", "row"])
    x = np.frombuffer(b"".join(rows["row"]), dtype=np.float32).reshape(-1, COLUMNS)
    return grow(x, rows["label"].to_numpy(np.int64))


def scorer(spark: SparkSession, trees: Trees):
    """A column function from a text to the probability of label 1."""
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-raw_scores(shared.value, statistics(texts)))))

    return scored


def score(docs: DataFrame, trees: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    return docs.withColumn(into, scorer(docs.sparkSession, trees)(F.col(text)))


def accepted(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with the columns of ``docs``."""
    return docs.where(scorer(docs.sparkSession, trees)(F.col("text")) >= least)
