"""Document quality by gradient-boosted trees over histograms.

One pass over the whole texts gives each document a fixed row of statistics (character classes, word lengths, repeats of
words and lines), which is written once. Trees are grown on the rows of labelled documents that are not held out: all of
them up to max_train, beyond that a sample by a hash of the id. Statistics are binned by their quantiles; a level of a tree
is one histogram of gradients for each statistic. Trees are complete and kept as flat arrays, so that a batch of rows goes
down all trees at once, level by level, in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.plans.shared import materialize

MAX_TRAIN = 20_000
ROUNDS, DEPTH, RATE, RIDGE, LEAST, BINS = 60, 4, 0.15, 1.0, 4.0, 64
STATISTICS = (
    "chars", "words", "lines", "upper", "lower", "digits", "blanks", "stops", "signs", "bars", "brackets", "quotes", "wide", "controls",
    "word_length", "longest_word", "distinct_words", "commonest_word", "word_repeats", "distinct_lines", "line_repeats", "sign_words", "upper_words", "long_words",
)
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r", b".,;:?", b"!#$%&*+=@^~", b"|/\\_-", b"()[]{}<>", b"'\"`", bytes(range(128, 256)), bytes(range(9)) + bytes(range(14, 32)) + b"\x7f")
_MEMBER = np.array([[b in c for c in _CLASSES] for b in range(256)], float)
_SIGNS = frozenset("!#$%&*+=@^~|<>{}[]\\_")


def statistics(text: str | None) -> list[float]:
    """The statistics of a text, in the order of STATISTICS; a null text counts as empty. Shares of nothing are 0."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    classes = np.bincount(data, minlength=256) @ _MEMBER / max(1, len(data))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    counts, n = Counter(words), max(1, len(words))
    sizes = [len(w) * k for w, k in counts.items()]
    line_counts = Counter(lines)
    repeated = sum(len(x) * (k - 1) for x, k in line_counts.items())
    return [
        log1p(len(text)), log1p(len(words)), log1p(len(lines)), *classes.tolist(),
        sum(sizes) / n, log1p(max(map(len, counts), default=0)), len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        len(line_counts) / max(1, len(lines)), repeated / max(1, len(text)),
        sum(k for w, k in counts.items() if w[-1] in _SIGNS) / n, sum(k for w, k in counts.items() if len(w) > 1 and w.isupper()) / n, sum(k for w, k in counts.items() if len(w) > 30) / n,
    ]


class Trees:
    """Complete binary trees of one depth. Node i of a tree has children 2i+1 and 2i+2; rows over a node's threshold go right.

    feature and threshold are (trees, 2^depth - 1), values (trees, 2^depth); a node that doesn't split has an infinite threshold.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, values: np.ndarray, base: float):
        self.feature, self.threshold, self.values, self.base = feature, threshold, values, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            inner = self.feature.shape[1]
            trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(trees)), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total = total + self.values[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bins(x: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(upper edges of each column's bins, the bin of each value)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    return edges, np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, least: float = LEAST, bins: int = BINS) -> Trees:
    """Trees for rows x and labels y (0 or 1). One class only, or no rows: no trees, and the smoothed share of label 1 as every score."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves, columns = 2**depth - 1, 2**depth, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges, binned = _bins(x, bins)
    score = np.full(len(y), base)
    made = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for c in range(columns):
                cell = (at - first) * bins + binned[:, c]
                left_g, left_h = (np.bincount(cell, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gain = np.where((left_h >= least) & (right_h >= least), gain, -1.0)[:, : len(edges[c])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    best[node], feature[first + node], threshold[first + node] = top[node], c, edges[c][k[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        values = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score = score + values[leaf]
        made.append((feature, threshold, values))
    return Trees(*(np.stack(z) for z in zip(*made, strict=True)), base)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row of (doc_id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, stats array<double>")


def learn(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees for (doc_id, stats) and labels (doc_id, quality), from rows that are not held out.

    An id counts once, with its largest label and its least statistics. At most about max_train rows of a few hundred bytes reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    total = known.count()
    if total > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / total))
    rows = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("stats").alias("stats")).select("doc_id", "quality", "stats").collect()  # at most about max_train ids
    rows.sort(key=lambda r: r["doc_id"])
    return grow(np.array([r["stats"] for r in rows], float).reshape(-1, len(STATISTICS)), np.array([r["quality"] for r in rows], float))


def score_of(stats: Column, trees: Trees) -> Column:
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(trees.scores(np.array(part.tolist(), float).reshape(-1, len(STATISTICS))), dtype="float64")

    return scored(stats)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have the statistics of nothing and get the score that the trees give these. Rows without an id are scored
    and not held out. Labels of one class give every row the smoothed share of that class; without labels every score is 0.5.
    Rows of one id count once in learning. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = materialize(measured(source), "statistics")
    trees = learn(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), max_train)
    scored = stats.select("doc_id", score_of(F.col("stats"), trees).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
